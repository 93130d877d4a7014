"""Cues cut out of the turns' texts, with full-width marks for the rules that look at them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cues as cu
from . import views
from .registry import register


def _lines(spark, d):
    return views.segments(spark, d).withColumn("text", F.translate("text", ".,", "。，"))


LINES = f"""{views.SEGMENTS},
lines as (select media_id, pos, start, "end", translate(text, '.,', '。，') as text from segments where text <> '')"""


@register(f"""
with {LINES},
units as (select media_id, pos, unnest(regexp_split_to_array(regexp_replace(text, '([。！？；]+)', '\\1' || chr(10), 'g'), '\\n')) as part, generate_subscripts(regexp_split_to_array(regexp_replace(text, '([。！？；]+)', '\\1' || chr(10), 'g'), '\\n'), 1) as k from lines),
kept as (select media_id, pos, k, regexp_extract(part, '[《（【“‘「『(]*[\\p{{L}}\\p{{N}}](?:.*[\\p{{L}}\\p{{N}}])?[，。！？、：；,.!?;:》）】”’」』]*') as text from units where regexp_matches(part, '[\\p{{L}}\\p{{N}}]'))
select media_id, pos, cast(row_number() over (partition by media_id, pos order by k) - 1 as int) as unit, trim(text) as text from kept
""")
def cue_units(spark, d):
    return cu.unit_rows(_lines(spark, d))


@register()
def cue_breaks(spark, d):
    return cu.cue_breaks(_lines(spark, d)).drop("checks")


@register()
def cue_breaks_least(spark, d):
    return cu.cue_breaks(_lines(spark, d), way="least").drop("checks")


@register()
def proposed_breaks(spark, d):
    """Proposed after each word of six characters or more, with what became of it."""
    kept = F.expr(r"transform(filter(transform(split(text, ' '), (w, i) -> struct(w, length(regexp_replace(array_join(slice(split(text, ' '), 1, i + 1), ''), '[^\\p{L}\\p{N}]', '')) as at)), x -> length(x.w) >= 6), x -> x.at)")
    rows = cu.cue_breaks(_lines(spark, d).withColumn("proposed", kept))
    return rows.select("media_id", "pos", "cue", "start", "end", "text", F.explode_outer("checks").alias("check")).select("media_id", "pos", "cue", "start", "end", "text", "check.at", "check.reason")


@register(f"""
with recursive {LINES},
chars as (
  select media_id, pos, start, "end", length(text) as n, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) - 1 as i from lines),
timed as (
  select media_id, row_number() over (partition by media_id order by pos, i) - 1 as k, c, start + (("end" - start) * (i + 0.5::double)) / n as t, c in ('。', '，') as good, count(*) over (partition by media_id) as total
  from chars),
costs as (
  select a.media_id, a.k, b.k + 1 as stop,
    ((abs((b.k - a.k + 1) - 20) * 0.22::double + abs((b.t - a.t) - 3.1::double) * 1.1::double) - case when b.good then 5.0::double else 0 end)
      - case when b.c in ('。', '！', '？', '；') then 3.0::double when b.c in ('，', '、', '：') then 1.2::double else 0 end + case when z.c in ('》', '）', '】', '”', '’') then 5.0::double else 0 end as cost
  from timed a join timed b on a.media_id = b.media_id and b.k between a.k + 7 and a.k + 33
  left join timed z on z.media_id = b.media_id and z.k = b.k + 1
  where b.t - a.t >= 0.75::double),
cheapest as (select media_id, k, min(stop) as stop from (select *, rank() over (partition by media_id, k order by cost) as r from costs) where r = 1 group by media_id, k),
jumps as (
  select timed.media_id, timed.k, t, total, case when total - timed.k <= 30 then total else coalesce(stop, least(total, timed.k + 24)) end as stop
  from timed left join cheapest on timed.media_id = cheapest.media_id and timed.k = cheapest.k),
ways as (
  select jumps.media_id, jumps.k, jumps.stop, jumps.total, greatest(0, jumps.t - 0.08::double) as b, e.t + 0.08::double as e from jumps join timed e on e.media_id = jumps.media_id and e.k = jumps.stop - 1),
steps as (select media_id, k, stop, total, b, case when e > b then e else b + 0.12::double end as e, e as own from ways),
walk as (
  select media_id, k, stop, total, b, cast(printf('%.3f', e) as double) as e from steps where k = 0
  union all
  select w.media_id, s.k, s.stop, s.total, greatest(s.b, w.e), cast(printf('%.3f', case when s.own > greatest(s.b, w.e) then s.own else greatest(s.b, w.e) + 0.12::double end) as double)
  from walk w join steps s on s.media_id = w.media_id and s.k = w.stop)
select walk.media_id, cast(walk.k as int) as from_char, cast(walk.stop as int) as to_char, cast(printf('%.3f', b) as double) as start, e as "end",
  (select string_agg(c, '' order by t.k) from timed t where t.media_id = walk.media_id and t.k >= walk.k and t.k < walk.stop) as text,
  (select good from timed t where t.media_id = walk.media_id and t.k = walk.stop - 1) as preferred
from walk
""")
def reading_cues(spark, d):
    """Preferred after every mark of a pause."""
    marks = F.expr("transform(filter(transform(split(text, ''), (c, i) -> struct(c, i + 1 as at)), x -> x.c in ('。', '，')), x -> x.at)")
    return cu.reading_cues(_lines(spark, d).withColumn("preferred", marks))


@register(f"""
with recursive {LINES},
limits as (select media_id, max("end") * 0.75::double as until from segments group by media_id),
whole as (select media_id, string_agg(text, chr(10) order by pos) as whole from lines group by media_id),
chars as (
  select media_id, pos, start, "end", unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i,
    coalesce(sum(length(text) + 1) over (partition by media_id order by pos rows between unbounded preceding and 1 preceding), 0) as before
  from lines),
kept as (
  select media_id, pos, i + before as place, start + (("end" - start) * (row_number() over (partition by media_id, pos order by i) - 0.5::double)) / count(*) over (partition by media_id, pos) as t
  from (select * from chars where regexp_matches(c, '[\\p{{L}}\\p{{N}}]'))),
sorted as (select kept.media_id, kept.pos, place, t, until from kept join limits using (media_id) qualify coalesce(bool_or(t > until) over (partition by media_id order by place), false) = false),
timed as (select media_id, row_number() over (partition by media_id order by place) - 1 as k, place, t, until, count(*) over (partition by media_id) as total from sorted),
longer as (
  select a.media_id, a.k, min(b.k) as stop
  from timed a join timed b on a.media_id = b.media_id and b.k between a.k + 24 and a.k + 32 join timed p on p.media_id = b.media_id and p.k = b.k - 1
  where b.k = a.k + 32 or p.t - a.t >= 2.8::double group by a.media_id, a.k),
jumps as (select timed.media_id, timed.k, least(total, coalesce(stop, total)) as stop from timed left join longer on timed.media_id = longer.media_id and timed.k = longer.k),
walk as (
  select media_id, k, stop from jumps where k = 0
  union all select jumps.media_id, jumps.k, jumps.stop from walk join jumps on jumps.media_id = walk.media_id and jumps.k = walk.stop),
cues as (
  select walk.media_id, walk.k, walk.stop, a.place as p, b.place as q, greatest(0, a.t - 0.06::double) as b, least(a.until, b.t + 0.06::double) as e
  from walk join timed a on a.media_id = walk.media_id and a.k = walk.k join timed b on b.media_id = walk.media_id and b.k = walk.stop - 1)
select cues.media_id, cast(k as int) as from_char, cast(stop as int) as to_char, b as start, case when e <= b then b + 0.1::double else e end as "end", substr(whole, cast(p as bigint), cast(q - p + 1 as bigint)) as text
from cues join whole using (media_id)
""")
def template_cues(spark, d):
    s = _lines(spark, d)
    until = s.groupBy("media_id").agg((F.max("end") * 0.75).alias("until"))
    return cu.template_cues(s.join(until, "media_id"), "until")
