"""Chunk flows over the turns, heard again in chunks: a first attempt of each chunk, and a second where the first is bad."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows as fl
from . import views
from .registry import register


def _media(s):
    return s.groupBy("media_id").agg((F.ceil(F.max("end")) + 1).cast("double").alias("duration"))


def _heard(s, windows):
    """The turns that a window touches, in its own time: (media_id, chunk, pos, start, end, text)."""
    w = windows.select("media_id", "chunk", F.col("start").alias("w"), F.col("duration").alias("d"))
    both = s.join(w, "media_id").where((F.col("end") > F.col("w")) & (F.col("start") < F.col("w") + F.col("d")))
    return both.select("media_id", "chunk", "pos", (F.col("start") - F.col("w")).alias("start"), (F.col("end") - F.col("w")).alias("end"), "text")


def _attempts(heard, windows):
    """Attempt 0 hears a phrase over and over in chunks whose first text has a q, attempt 1 hears all well."""
    bad = heard.groupBy("media_id", "chunk").agg(F.min_by("text", "pos").alias("t")).where("t like '%q%'").select("media_id", "chunk")
    noise = heard.join(bad, ["media_id", "chunk"], "left_semi").withColumn("text", F.lit("la " * 60))
    rows = heard.join(bad, ["media_id", "chunk"], "left_anti").unionByName(noise).withColumn("attempt", F.lit(0))
    rows = rows.unionByName(heard.join(bad, ["media_id", "chunk"], "left_semi").withColumn("attempt", F.lit(1)))
    asked = windows.select("media_id", "chunk", F.lit(0).alias("attempt")).unionByName(bad.withColumn("attempt", F.lit(1)))
    return rows, asked.withColumn("language", F.when(F.col("attempt") == 1, "fr").otherwise(F.when(F.col("chunk") % 2 == 0, "en").otherwise("")))


@register()
def overlapped_chunks(spark, d):
    s = views.segments(spark, d)
    media = _media(s)
    windows = fl.overlapped_windows(media)
    rows, attempts = _attempts(_heard(s, windows), windows)
    return fl.overlapped_flow(media, attempts, rows)[0]


_FIXED = f"""{views.SEGMENTS},
media as (select media_id, ceil(max("end")) + 1 as duration from segments group by media_id),
windows as (
  select media_id, duration as whole, unnest(range(0, cast(greatest(1, ceil(duration / 60)) as bigint))) as chunk from media),
win as (select media_id, chunk, chunk * 60.0::double as w, least(60.0::double, whole - chunk * 60.0::double) as d from windows),
heard as (select win.media_id, chunk, pos, start - w as start, "end" - w as "end", text, w, d from segments join win on segments.media_id = win.media_id where "end" > w and start < w + d),
voiced as (select media_id, chunk, arg_min(greatest(0, start), pos) + 2.5::double as voice, arg_min(text, pos) like '%q%' as bad from heard group by media_id, chunk having max(length(text)) >= 200)"""


def _voice(heard):
    got = heard.groupBy("media_id", "chunk").agg((F.min_by(F.greatest(F.lit(0.0), F.col("start")), "pos") + 2.5).alias("voice"), F.max(F.length("text")).alias("n"))
    return got.where("n >= 200").select("media_id", "chunk", "voice", F.lit(60.0).alias("length"))


@register(f"""
with {_FIXED},
inside as (select h.media_id, h.chunk, pos, least(d, greatest(0, start)) as s, least(d, greatest(0, "end")) as e, text, w, voice, row_number() over (partition by h.media_id, h.chunk order by pos) as n from heard h join voiced v on h.media_id = v.media_id and h.chunk = v.chunk),
snapped as (select *, case when n = 1 and s <= 0.1::double and voice >= 2 then least(e, voice) else s end as t from inside)
select media_id, cast(chunk as int) as chunk, pos, t + w as start, e + w as "end", text from snapped where trim(text) <> '' and e > t
""")
def fixed_chunks(spark, d):
    s = views.segments(spark, d)
    media = _media(s)
    windows = fl.fixed_windows(media)
    heard = _heard(s, windows)
    rows, attempts = _attempts(heard, windows)
    return fl.fixed_flow(media, attempts, rows, _voice(heard))[0]


@register(f"""
with {_FIXED},
tried as (select v.media_id, v.chunk, 0 as attempt, case when v.chunk % 2 = 0 then 'en' else '' end as language from voiced v union all select v.media_id, v.chunk, 1, 'fr' from voiced v where bad),
named as (select media_id, arg_max(language, chunk * 10 + attempt) as language from tried where language <> '' group by media_id)
select media.media_id, coalesce(language, '') as language, 'ok' as status, cast(null as varchar) as issue from media left join named using (media_id)
""")
def fixed_chunk_verdicts(spark, d):
    s = views.segments(spark, d)
    media = _media(s)
    windows = fl.fixed_windows(media)
    heard = _heard(s, windows)
    rows, attempts = _attempts(heard, windows)
    return fl.fixed_flow(media, attempts, rows, _voice(heard))[1]


@register(f"""
with {_FIXED.replace("60.0::double", "120.0::double").replace("duration / 60", "duration / 120")},
texts as (select media_id, chunk, string_agg(text, ' ' order by pos) as text, count(*) as n from heard group by media_id, chunk)
select win.media_id, count(*) as chunks, cast(coalesce(sum(n), 0) as bigint) as rows, regexp_replace(coalesce(string_agg(text, chr(10) order by win.chunk), ''), '^\\s+|\\s+$', '', 'g') as text
from win left join texts using (media_id, chunk) group by win.media_id
""")
def long_chunk_texts(spark, d):
    s = views.segments(spark, d)
    media = _media(s)
    heard = _heard(s, fl.fixed_windows(media, 120.0))
    texts = heard.groupBy("media_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), " ").alias("text"))
    return fl.text_flow(media, texts, heard, 120.0)[1]
