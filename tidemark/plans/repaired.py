"""Queries over repairs and small choices: filled times, reviews, newest rows, raw blocks, captions, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit as au
from ..operators import evidence as ev
from ..operators import reports as rp
from ..operators import state as st
from ..sources import sinks, subtitles
from . import views
from .registry import register
from .reread import CLEAN, _clean, _named


@register(f"""
with {views.SEGMENTS},
r as (select media_id, pos, case when length(text) % 2 = 0 then start end as t from segments),
w as (
  select *, last_value(t ignore nulls) over before_ as a, last_value(case when t is not null then pos end ignore nulls) over before_ as pa,
    first_value(t ignore nulls) over after_ as b, first_value(case when t is not null then pos end ignore nulls) over after_ as pb
  from r window before_ as (partition by media_id order by pos rows between unbounded preceding and current row), after_ as (partition by media_id order by pos rows between current row and unbounded following))
select media_id, pos, round(case when a is null then b when b is null then a when pa = pb then a else a + (b - a) * (pos - pa) / (pb - pa) end, 6) as t from w
""")
def filled_times(spark, d):
    rows = views.segments(spark, d).select("media_id", "pos", F.when(F.length("text") % 2 == 0, F.col("start")).alias("t"))
    return ev.filled_times(rows).select("media_id", "pos", F.round("t", 6).alias("t"))


@register(f"""
with {views.SEGMENTS},
f as (select media_id, 'native.' || length(text) % 7 as path, pos, text from segments where trim(text) <> '' and "end" > start),
m as (select media_id, min(path) as path from f group by media_id)
select media_id, path, pos from f join m using (media_id, path)
""")
def first_usable_file(spark, d):
    rows = views.segments(spark, d).withColumn("path", F.concat(F.lit("native."), (F.length("text") % 7).cast("string")))
    return subtitles.first_usable(rows, "media_id").select("media_id", "path", "pos")


@register("""
with k as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where ts is not null)
select user_id, event_id, n as place from k where n <= 8
""")
def newest_events(spark, d):
    e = views.table(spark, d, "events").where("ts is not null")
    return st.newest(e, 8, "ts", "event_id", keys=["user_id"]).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@register(f"""
with {views.SEGMENTS},
every as (select 0 as v, media_id, pos, text from segments union all select 1, media_id, pos, case when length(text) % 2 = 1 then text || 'xx' else left(text, length(text) - 1) end from segments),
l as (select *, trim(text) = trim(lag(text) over (partition by v, media_id order by pos)) as same, regexp_replace(text, '\\s+', '', 'g') as c from every),
s as (select v, media_id, row(-sum(length(c) - length(replace(c, chr(65533), ''))), -sum(case when same then 1 else 0 end), sum(length(c))) as score from l group by v, media_id),
chosen as (select a.media_id, case when b.score >= a.score then 1 else 0 end as v from s a join s b on a.media_id = b.media_id and a.v = 0 and b.v = 1)
select media_id, pos, md5(text) as text from every join chosen using (media_id, v)
""")
def reviewed_rows(spark, d):
    s = views.segments(spark, d)
    n = F.length("text")
    review = s.withColumn("text", F.when(n % 2 == 1, F.concat("text", F.lit("xx"))).otherwise(F.substring("text", F.lit(1), n - 1)))
    return au.better_of(s, review).select("media_id", "pos", F.md5("text").alias("text"))


def _stamp(ms):
    return f"format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@register(f"""
with {CLEAN},
w as (select media_id, place + 1 as number, cast(round(start * 1000) as bigint) as a, cast(round("end" * 1000) as bigint) as b, text from clean where text <> '')
select media_id, cast(number as int) as number, {_stamp('a')} as start_stamp, {_stamp('b')} as end_stamp, text from w
""")
def raw_blocks(spark, d):
    got = subtitles.raw_blocks(_named(sinks.srt_documents(_clean(spark, d))))
    return got.select(F.col("path").alias("media_id"), "number", "start_stamp", "end_stamp", "text")


@register("""
select doc_id, array_to_string(list_sort(list_distinct(list_filter([length(text) % 7, length(text) % 5, length(text) % 11, 3], lambda b: b > 0 and b < 6))), ',') as breaks
from (select doc_id, coalesce(text, '') as text from documents)
""")
def break_sets(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    breaks = rp.break_set(F.array(n % 7, n % 5, n % 11, F.lit(3)), F.lit(6))
    return views.table(spark, d, "documents").select("doc_id", F.array_join(breaks.cast("array<string>"), ",").alias("breaks"))


@register(f"""
with {CLEAN}
select media_id, pos, case when length(text) % 3 = 1 then '' else text end as caption from kept
""")
def captions(spark, d):
    rows = _clean(spark, d).where("text <> ''")
    n = F.length("text") % 3
    line = F.when(n == 0, F.concat(F.lit("[00:00 --> 00:01]  "), "text")).when(n == 1, F.concat(F.lit("whisper_"), "text")).otherwise(F.concat(F.lit(" "), "text"))
    by = F.row_number().over(Window.partitionBy("media_id").orderBy("pos")) - 1
    return rows.select("media_id", by.alias("pos"), tx.caption(line).alias("caption"))


@register("""
with n as (select doc_id, length(coalesce(text, '')) as n from documents)
select doc_id, round(case when n % 13 = 0 then 1.0 when n % 7 = 0 then least(n % 11 / (n % 13), 0.3) else 0.4 * (n % 11) / (n % 13) + 0.6 * (n % 5) / (n % 7) end::double, 6) as confidence from n
""")
def fusion_confidences(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    got = ev.fusion_confidence(n % 5, n % 7, n % 11, n % 13)
    return views.table(spark, d, "documents").select("doc_id", F.round(got, 6).alias("confidence"))


@register(f"""
with {views.SEGMENTS},
m as (select media_id, max("end") - 1 as duration, min(pos) as first_ from segments group by media_id),
c as (select media_id, pos, text, greatest(0, least(duration, start)) as s, greatest(0, least(duration, "end")) as e, pos = first_ as f from segments join m using (media_id)),
v as (select media_id, pos, case when f and s <= 0.1 then least(e, 2.5) else s end as s, e from c where trim(text) <> '')
select media_id, pos, round(s, 6) as start, round(e, 6) as "end" from v where e > s
""")
def snapped_rows(spark, d):
    s = views.segments(spark, d)
    windows = s.groupBy("media_id").agg((F.max("end") - 1).alias("duration")).withColumn("voice", F.lit(2.5))
    return ev.snapped_to_voice(s, windows).select("media_id", "pos", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@register(f"with {CLEAN} select media_id, md5(string_agg(text, chr(10) order by pos)) as text from kept group by media_id")
def text_leaves(spark, d):
    leaf = F.struct(F.lit("text").alias("type"), "text")
    rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(F.lit("step").alias("type"), F.array(leaf).alias("content")).alias("s"))))
    made = _clean(spark, d).where("text <> ''").groupBy("media_id").agg(F.to_json(F.struct(F.transform(rows, lambda r: r["s"]).alias("steps"))).alias("content"))
    return made.select("media_id", F.md5(tx.text_leaves(F.col("content"))).alias("text"))
