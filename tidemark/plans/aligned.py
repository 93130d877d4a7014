"""The turns against a second reading of them, whose clock runs fast and which hears each q as another letter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors as an
from . import views
from .registry import register


def _readings(spark, d):
    s = views.segments(spark, d)
    late = lambda c: (F.col(c) * 1.0078125 + 0.3).alias(c)
    other = s.select("media_id", "pos", late("start"), late("end"), F.translate("text", "qQ", "øØ").alias("text"), (F.floor(F.col("pos") / 3) + 1).cast("int").alias("chunk"))
    return s, other


def _media(s):
    return s.groupBy("media_id").agg(F.max("end").alias("duration"))


#: Kept characters with both times; those that match are all but the q.
CHARS = f"""{views.SEGMENTS},
chars as (
  select media_id, pos, start, "end", unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from segments where text <> ''),
kept as (
  select media_id, pos, i, lower(c) <> 'q' as ok, row_number() over (partition by media_id, pos order by i) - 1 + 0.5::double as j, count(*) over (partition by media_id, pos) as n, start, "end"
  from (select * from chars where regexp_matches(c, '[\\p{{L}}\\p{{N}}]'))),
timed as (
  select media_id, pos // 3 + 1 as chunk, ok, start + (("end" - start) * j) / n as lt,
    (start * 1.0078125::double + 0.3::double) + (("end" * 1.0078125::double + 0.3::double) - (start * 1.0078125::double + 0.3::double)) * j / n as rt from kept),
media as (select media_id, max("end") as duration from segments group by media_id)"""


@register(f"""
with {CHARS}
select media.media_id, count(ok) as left_chars, count(ok) as right_chars, cast(count(*) filter (where ok) as bigint) as matched,
  round(count(*) filter (where ok) / greatest(1, count(ok)), 6) as coverage, round(count(*) filter (where ok) / greatest(1, count(ok)), 6) as "precision",
  case when count(ok) = 0 then 1.0 else round(count(*) filter (where ok) / count(ok), 6) end as similarity, round(count(ok) / greatest(1, count(ok)), 6) as length_ratio
from media left join timed using (media_id) group by media.media_id
""")
def reading_stats(spark, d):
    left, right = _readings(spark, d)
    l, r = an.held(left), an.held(right)
    return an.text_stats(left.select("media_id"), l, r, an.aligned_blocks(l, r))


@register(f"""
with {CHARS},
errors as (select media_id, abs(rt - lt) as e, row_number() over (partition by media_id order by abs(rt - lt)) as n, count(*) over (partition by media_id) as total from timed where ok),
sums as (select media_id, count(*) as matched, median(e) as m, max(e) as x, max(case when n = greatest(0, cast(floor(total * 0.9) as bigint) - 1) + 1 then e end) as p from errors group by media_id)
select media.media_id, coalesce(matched, 0) as matched, round(coalesce(m, 0), 3) as median_error, round(coalesce(p, 0), 3) as p90_error, round(coalesce(x, 0), 3) as max_error from media left join sums using (media_id)
""")
def reading_errors(spark, d):
    left, right = _readings(spark, d)
    return an.timed_report(left, right, _media(left), 60.0)[0]


@register(f"""
with {CHARS}
select media_id, cast(chunk as int) as chunk, count(*) as characters, cast(count(*) filter (where ok) as bigint) as matched, round(coalesce(min(lt) filter (where ok), 0), 3) as from_time,
  round(coalesce(max(lt) filter (where ok), 0), 3) as to_time, round(coalesce(median(rt - lt) filter (where ok), 0), 3) as signed_error, round(coalesce(median(abs(rt - lt)) filter (where ok), 0), 3) as absolute_error
from timed group by media_id, chunk
""")
def reading_chunks(spark, d):
    left, right = _readings(spark, d)
    return an.timed_report(left, right, _media(left), 60.0)[1]


@register(f"""
with {CHARS},
spans as (select media_id, duration, unnest(range(0, cast(ceil(duration / 60) as bigint))) as k from media where duration > 0),
told as (select media_id, cast(floor(lt / 60) as bigint) as k, count(*) as characters, count(*) filter (where ok) as matched from timed join media using (media_id) where lt < duration group by all)
select s.media_id, cast(s.k as int) as "window", s.k * 60.0::double as start, least(duration, (s.k + 1) * 60.0::double) as "end", coalesce(characters, 0) as characters, coalesce(matched, 0) as matched,
  round(coalesce(matched, 0) / greatest(1, coalesce(characters, 0)), 6) as coverage
from spans s left join told t on s.media_id = t.media_id and s.k = t.k
""")
def reading_spans(spark, d):
    left, right = _readings(spark, d)
    return an.timed_report(left, right, _media(left), 60.0)[2]
