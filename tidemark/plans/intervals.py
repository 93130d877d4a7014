"""Queries over interval algebra, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from . import views
from .registry import register

LONGEST = "durations as (select media_id, max(\"end\") + 1 as duration from intervals group by media_id)"


def _durations(rows):
    return rows.groupBy("media_id").agg((F.max("end") + 1).alias("duration"))


def _views_only(spark, d):
    v = views.intervals(spark, d)
    return v, v.where("label = 'view'"), v.where("label = 'click'")


@register(f"""
with {views.INTERVALS},
padded as (select media_id, pos, greatest(0.0, start - 2.0) as start, "end" + 2.0 as "end", label from intervals),
marked as (select *, max("end") over (partition by media_id order by start, pos rows between unbounded preceding and 1 preceding) as reach from padded),
placed as (select *, sum(case when reach is null or start - reach >= 0.5 then 1 else 0 end) over (partition by media_id order by start, pos) as island from marked),
firsts as (select media_id, island, label, min(row(start, pos)) as first_seen from (select media_id, island, label, start, pos from placed) group by media_id, island, label),
reasons as (select media_id, island, string_agg(label, ', ' order by first_seen) as reason from firsts group by media_id, island)
select p.media_id, cast(p.island as bigint) as region, min(p.start) as start, max(p."end") as "end", any_value(r.reason) as reason
from placed p join reasons r on p.media_id = r.media_id and p.island = r.island group by p.media_id, p.island
""")
def merge_regions(spark, d):
    return iv.merge_regions(views.intervals(spark, d), guard=2.0, merge_gap=0.5, reason="label")


@register(f"""
with {views.INTERVALS},
marked as (select *, max("end") over (partition by media_id order by start, pos rows between unbounded preceding and 1 preceding) as reach from intervals),
placed as (select *, sum(case when reach is null or start - reach > 30 then 1 else 0 end) over (partition by media_id order by start, pos) as island from marked)
select media_id, cast(island as bigint) as island, count(*) as n, min(start) as start, max("end") as "end" from placed group by media_id, island
""")
def islands_closed(spark, d):
    rows = iv.islands(views.intervals(spark, d), gap=30.0, closed=True)
    return rows.groupBy("media_id", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


@register(f"""
with {views.INTERVALS}, {LONGEST},
rows_ as (select media_id, start, "end" from intervals union all select media_id, duration, duration from durations),
gaps as (select media_id, greatest(0.0, coalesce(max("end") over (partition by media_id order by start, "end" rows between unbounded preceding and 1 preceding), 0.0)) as s, start as e from rows_)
select media_id, round(s, 3) as start, round(e, 3) as "end" from gaps where e - s >= 0.1
""")
def complement(spark, d):
    rows = views.intervals(spark, d)
    found = iv.complement(rows, _durations(rows), 0.1)
    return found.select("media_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


COVER = """
regions as (select media_id, pos, start, "end" from intervals where label = 'view'),
cover as (select media_id, pos, start, "end" from intervals where label = 'click')
"""


@register(f"""
with {views.INTERVALS}, {COVER},
sums as (
  select r.media_id, r.pos, any_value(r."end" - r.start) as span, coalesce(sum(case when c.pos is null then 0.0 else greatest(0.0, least(r."end", c."end") - greatest(r.start, c.start)) end), 0.0) as total
  from regions r left join cover c on r.media_id = c.media_id and c.start < r."end" and c."end" > r.start group by r.media_id, r.pos)
select media_id, count(*) as n_regions, sum(case when span - least(total, span) > 0.6 then 1 else 0 end)::bigint as uncovered,
  round(case when sum(span) <= 0 then 1.0 else least(1.0, sum(least(total, span)) / sum(span)) end, 6) as coverage
from sums group by media_id
""")
def coverage(spark, d):
    _, regions, rows = _views_only(spark, d)
    got = iv.covered_seconds(regions.select("media_id", "pos", "start", "end"), rows)
    span = F.col("end") - F.col("start")
    return got.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("n_regions"),
        F.sum((span - F.col("covered") > 0.6).cast("long")).alias("uncovered"),
        F.round(F.when(F.sum(span) <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.sum("covered") / F.sum(span))), 6).alias("coverage"),
    )


@register(f"""
with {views.INTERVALS}, {COVER},
sums as (
  select r.media_id, r.pos, any_value(r."end" - r.start) as span, coalesce(sum(case when c.media_id is null then 0.0 else least(r."end", c."end") - greatest(r.start, c.start) end), 0.0) as total
  from regions r left join cover c on r.media_id = c.media_id and c.start < r."end" and c."end" > r.start group by r.media_id, r.pos)
select media_id, pos, round(least(total, span), 3) as covered from sums
""")
def covered_regions(spark, d):
    _, regions, rows = _views_only(spark, d)
    got = iv.covered_seconds(regions.select("media_id", "pos", "start", "end"), rows)
    return got.select("media_id", "pos", F.round("covered", 3).alias("covered"))


@register(f"""
with {views.INTERVALS}, {COVER}
select media_id, pos from cover c where not exists (select 1 from regions r where r.media_id = c.media_id and c."end" > r.start and c.start < r."end")
""")
def rows_outside_regions(spark, d):
    _, regions, rows = _views_only(spark, d)
    return iv.not_touching(rows, regions).select("media_id", "pos")


@register(f"""
with {views.INTERVALS}, {COVER}
select media_id, pos from cover c where exists (select 1 from regions r where r.media_id = c.media_id and c."end" > r.start and c.start < r."end")
""")
def rows_inside_regions(spark, d):
    _, regions, rows = _views_only(spark, d)
    return iv.touching(rows, regions).select("media_id", "pos")


@register(f"""
with {views.INTERVALS}, {COVER}
select r.media_id, r.pos as pos, c.pos as r_pos, round(least(r."end", c."end") - greatest(r.start, c.start), 3) as shared
from regions r join cover c on r.media_id = c.media_id and r.start < c."end" and r."end" > c.start
""")
def binned_overlap_join(spark, d):
    _, regions, rows = _views_only(spark, d)
    got = iv.binned_overlap_join(regions.select("media_id", "pos", "start", "end"), rows.select("media_id", "pos", "start", "end"), width=3600.0)
    return got.select("media_id", "pos", "r_pos", F.round(F.least("end", "r_end") - F.greatest("start", "r_start"), 3).alias("shared"))


@register(f"""
with {views.INTERVALS},
probes as (select media_id, pos as probe, start as t from intervals where label = 'purchase'),
rows_ as (select media_id, pos, start, "end" from intervals where label = 'view'),
ranked as (
  select p.media_id, p.probe, p.t, r.pos, r."end", row_number() over (partition by p.media_id, p.probe order by r.start desc nulls last, r.pos desc) as k
  from probes p left join rows_ r on p.media_id = r.media_id and r.start <= p.t)
select media_id, probe, case when "end" >= t then pos end as current from ranked where k = 1
""")
def as_of_current(spark, d):
    v = views.intervals(spark, d)
    probes = v.where("label = 'purchase'").select("media_id", F.col("pos").alias("probe"), F.col("start").alias("t"))
    return iv.as_of(probes, v.where("label = 'view'")).select("media_id", "probe", "current")


@register(f"""
with {views.INTERVALS},
probes as (select media_id, pos as probe, start as t from intervals where label = 'error'),
rows_ as (select media_id, pos, start from intervals where label = 'purchase'),
ranked as (
  select p.media_id, p.probe, r.pos, row_number() over (partition by p.media_id, p.probe order by r.start nulls last, r.pos) as k
  from probes p left join rows_ r on p.media_id = r.media_id and r.start >= p.t - 0.5)
select media_id, probe, pos as next from ranked where k = 1
""")
def first_at_or_after(spark, d):
    v = views.intervals(spark, d)
    probes = v.where("label = 'error'").select("media_id", F.col("pos").alias("probe"), F.col("start").alias("t"))
    return iv.first_at_or_after(probes, v.where("label = 'purchase'")).select("media_id", "probe", "next")


@register(f"""
with {views.INTERVALS}, {LONGEST},
ordered as (select media_id, start, "end", pos, lag("end") over (partition by media_id order by start, pos) as prev from intervals),
tails as (select media_id, arg_max("end", (start, pos)) as s from (select media_id, start, pos, "end" from intervals) group by media_id),
gaps as (select media_id, coalesce(prev, 0.0) as s, start as e from ordered union all select t.media_id, s, duration from tails t join durations using (media_id))
select media_id, round(s, 3) as gap_start, round(e, 3) as gap_end from gaps where e - s >= 3.0
""")
def word_gaps(spark, d):
    rows = views.intervals(spark, d)
    got = iv.word_gaps(rows, _durations(rows), 3.0)
    return got.select("media_id", F.round("gap_start", 3).alias("gap_start"), F.round("gap_end", 3).alias("gap_end"))


@register(f"""
with {views.SEGMENTS},
seen as (
  select *, lag(start) over (partition by media_id order by pos) as prev,
    start - max("end") over (partition by media_id order by pos rows between unbounded preceding and 1 preceding) as gap from segments)
select media_id, count(*) as n, count(*) filter (where "end" <= start) as invalid, count(*) filter (where start < prev) as backwards,
  count(*) filter (where gap > 1.0) as long_gaps, round(greatest(0.0, coalesce(max(gap), 0.0)), 3) as max_gap, max("end") as last_end
from seen group by media_id
""")
def timeline_report(spark, d):
    return iv.timeline_report(views.segments(spark, d), long_gap=1.0)


@register(f"""
with {views.SEGMENTS},
seen as (select *, "end" <= start or start < lag(start) over (partition by media_id order by pos) - 0.001 as bad from segments)
select media_id, min(case when bad then pos end) as first_bad from seen group by media_id
""")
def first_disorder(spark, d):
    return iv.first_disorder(views.segments(spark, d))


@register(f"""
with {views.SEGMENTS}
select media_id, pos, round(greatest(start + 1.5, 2.0), 3) as start, round(least("end" + 1.5, 20.0), 3) as "end"
from segments where round(least("end" + 1.5, 20.0), 3) - round(greatest(start + 1.5, 2.0), 3) > 0
""")
def shift_and_trim(spark, d):
    rows = iv.trim_to_window(iv.shift(views.segments(spark, d), 1.5), leading=2.0, trailing=5.0, duration=25.0)
    return rows.select("media_id", "pos", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@register(f"""
with {views.SEGMENTS} select media_id, pos from segments where "end" >= 10.0 - 0.75 and start <= 20.0 + 0.75
""")
def overlapping_window(spark, d):
    return iv.overlapping(views.segments(spark, d), 10.0, 20.0).select("media_id", "pos")


@register(f"""
with {views.SEGMENTS},
media as (select media_id, max("end") as duration from segments group by media_id),
n as (select media_id, duration, greatest(1, cast(ceil(duration / 10.0) as bigint)) as n from media),
c as (select media_id, duration, n, unnest(range(0, n)) as chunk from n)
select media_id, cast(chunk as int) as chunk, round(chunk * 10.0::double - case when chunk > 0 then 2.0 else 0.0 end, 3) as start,
  round(least(duration, (chunk + 1) * 10.0::double) - chunk * 10.0 + case when chunk > 0 then 2.0 else 0.0 end + case when chunk < n - 1 then least(2.0, duration - least(duration, (chunk + 1) * 10.0)) else 0.0 end, 3) as duration
from c
""")
def chunk_windows(spark, d):
    media = views.segments(spark, d).groupBy("media_id").agg(F.max("end").alias("duration"))
    got = iv.chunk_windows(media, chunk=10.0, context=2.0)
    return got.select("media_id", "chunk", F.round("start", 3).alias("start"), F.round("duration", 3).alias("duration"))


@register(f"""
with {views.SEGMENTS},
media as (select media_id, max("end") as duration from segments group by media_id),
g as (select media_id, least(60.0, duration * 0.05) as guard, duration from media)
select media_id, cast(k as int) as sample, round(guard + k * greatest(0.0, duration - 2 * guard - 3.0) / 3, 6) as start from g, range(0, 4) r(k)
""")
def sampled_starts(spark, d):
    media = views.segments(spark, d).groupBy("media_id").agg(F.max("end").alias("duration"))
    return iv.sampled_starts(media, count=4, seconds=3.0, digits=6)


@register(f"""
with {views.SEGMENTS},
regions as (select media_id, start, "end" from segments where pos % 3 = 1),
originals as (select * from segments where pos % 2 = 0),
repl as (select media_id, pos, start + 0.25 as start, "end" + 0.25 as "end", text from segments where pos % 2 = 1),
inserted as (select * from repl s where exists (select 1 from regions r where r.media_id = s.media_id and s."end" > r.start and s.start < r."end")),
kept as (
  select * from originals s where not exists (select 1 from regions r where r.media_id = s.media_id and s."end" > r.start and s.start < r."end")
    and not exists (select 1 from regions r join inserted i on r.media_id = i.media_id where r.media_id = s.media_id and s."end" <= r.start and s."end" > i.start and s.start < i."end")),
every as (select *, 0 as inserted from kept union all select *, 1 as inserted from inserted),
normed as (select *, cast(round_even(start * 5, 0) as bigint) as slot, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) as norm from every),
ranked as (select *, row_number() over (partition by media_id, slot, norm order by start, "end" desc, inserted, pos) as k from normed where norm <> '')
select media_id, pos, inserted, round(start, 3) as start, round("end", 3) as "end" from ranked where k = 1
""")
def replace_in_regions(spark, d):
    s = views.segments(spark, d)
    moved = s.where("pos % 2 = 1").withColumn("start", F.col("start") + 0.25).withColumn("end", F.col("end") + 0.25)
    got = iv.replace_in_regions(s.where("pos % 2 = 0"), moved, s.where("pos % 3 = 1"))
    return got.select("media_id", "pos", "inserted", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))
