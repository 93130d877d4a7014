"""Queries over chunk rows, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as ch
from . import views
from .registry import register


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("""
with w as (select conv_id as media_id, turn as pos, length(coalesce(text, '')) + 1 as weight, 100.0::double as duration from conversations),
s as (select *, sum(weight) over (partition by media_id) as total, sum(weight) over (partition by media_id order by pos) as upto from w)
select media_id, pos, round(duration * (upto - weight) / total, 6) as start, round(case when upto = total then duration else duration * upto / total end, 6) as "end" from s
""")
def spread_by_weight(spark, d):
    rows = views.table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("pos"), (F.length(F.coalesce("text", F.lit(""))) + 1).alias("weight"), F.lit(100.0).alias("duration"))
    return _six(ch.spread_by_weight(rows), "start", "end").select("media_id", "pos", "start", "end")


PLAN = f"""
{views.SEGMENTS},
plan as (
  select media_id, pos, 0 as part, start, case when "end" - start > 8 then start + 2 else "end" end as "end", 4.0::double as fps from segments
  union all select media_id, pos, 1, start + 2, "end" - 2, 1.0::double from segments where "end" - start > 8
  union all select media_id, pos, 2, "end" - 2, "end", 4.0::double from segments where "end" - start > 8),
sized as (select *, cast(ceil(("end" - start) * fps) as int) as frames from plan)
"""


@register(f"with {PLAN} select media_id, pos, part, round(start, 6) as start, round(\"end\", 6) as \"end\", fps, frames from sized")
def sampling_plan(spark, d):
    return _six(ch.sampling_plan(views.segments(spark, d)), "start", "end")


@register(f"with {PLAN}, f as (select *, unnest(range(0, frames)) as frame from sized where frames > 0) select media_id, pos, part, cast(frame as int) as frame, round(start + frame / fps, 6) as t from f")
def frame_times(spark, d):
    return ch.frame_times(ch.sampling_plan(views.segments(spark, d)))


@register(f"""
with {views.SEGMENTS}, m as (select media_id, max("end") as duration from segments group by media_id),
t as (select media_id, duration, unnest(range(0, greatest(1, cast(ceil(duration / 45.0) as bigint)))) as task from m)
select media_id, cast(task as int) as task, task * 45.0::double as start, round(least(45.0, duration - task * 45.0), 6) as duration from t
""")
def fixed_tasks(spark, d):
    media = views.segments(spark, d).groupBy("media_id").agg(F.max("end").alias("duration"))
    return _six(ch.tasks(media, 45.0), "duration")


@register(f"""
with {views.SEGMENTS}, every as (select *, 0 as file_no from segments union all select *, 1 as file_no from segments where length(text) > 80),
r as (select *, row_number() over (partition by media_id, round_even(start, 2), round_even("end", 2), text order by file_no desc, pos desc) as k from every)
select media_id, pos, file_no from r where k = 1
""")
def last_file_wins(spark, d):
    s = views.segments(spark, d)
    return ch.keep_last(s.withColumn("file_no", F.lit(0)).unionByName(s.where("length(text) > 80").withColumn("file_no", F.lit(1)))).select("media_id", "pos", "file_no")


@register(f"""
with {views.INTERVALS},
probes as (select media_id, pos as probe, start as t from intervals where label = 'view'),
chapters as (select media_id, start, pos as chapter from intervals where label = 'signup'),
a as (select p.media_id, probe, arg_max(chapter, row(start, chapter)) filter (where start <= t) as at_, arg_min(chapter, row(start, chapter)) as first_ from probes p left join (select media_id, start, chapter from chapters) c using (media_id) group by p.media_id, probe)
select media_id, probe, coalesce(at_, first_) as chapter from a
""")
def chapter_at(spark, d):
    v = views.intervals(spark, d)
    probes = v.where("label = 'view'").select("media_id", F.col("pos").alias("probe"), F.col("start").alias("t"))
    return ch.chapter_at(probes, v.where("label = 'signup'").select("media_id", "start", F.col("pos").alias("chapter"))).select("media_id", "probe", "chapter")


@register(f"""
with {views.SEGMENTS},
chap as (select media_id, start - 0.25 as start, 'at ' || pos as title from segments where length(text) > 100),
hit as (select c.media_id, c.start, c.title, arg_min(s.pos, row(s.start, s.pos)) as pos from chap c join segments s on s.media_id = c.media_id and s.start >= c.start - 0.5 group by c.media_id, c.start, c.title),
m as (select media_id, pos, string_agg('[' || title || ']', chr(10) order by start, title) as mark from hit group by media_id, pos)
select s.media_id, s.pos, md5(case when mark is null then text else mark || chr(10) || text end) as text from segments s left join m using (media_id, pos)
""")
def chapter_marks(spark, d):
    s = views.segments(spark, d)
    chapters = s.where("length(text) > 100").select("media_id", (F.col("start") - 0.25).alias("start"), F.concat(F.lit("at "), F.col("pos").cast("string")).alias("title"))
    return ch.with_chapter_marks(s, chapters).select("media_id", "pos", F.md5("text").alias("text"))


@register(f"""
with {views.SEGMENTS}
select media_id, pos, round(start + case when pos // 4 > 0 and max("end") over (partition by media_id, pos // 4) <= 40 then pos // 4 * 10.0::double else 0 end, 6) as start from segments
""")
def unclipped_chunks(spark, d):
    rows = views.segments(spark, d).withColumn("chunk", F.floor(F.col("pos") / 4))
    return _six(ch.unclipped(rows, 10.0), "start").select("media_id", "pos", "start")


@register(f"""
with {views.SEGMENTS}, c as (select media_id, pos, replace(text, 'a', 'A') as new from segments where text like '%a%')
select s.media_id, s.pos, md5(coalesce(nullif(trim(new), ''), text)) as text from segments s left join c using (media_id, pos)
""")
def corrected_lines(spark, d):
    s = views.segments(spark, d)
    c = s.where("text like '%a%'").select("media_id", F.floor(F.col("pos") / 3).alias("batch"), (F.col("pos") % 3).alias("line"), F.replace("text", F.lit("a"), F.lit("A")).alias("text"))
    return ch.corrected(s, c, 3).select("media_id", "pos", F.md5("text").alias("text"))
