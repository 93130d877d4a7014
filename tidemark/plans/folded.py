"""Queries over ordered folds and alignment: SQL can't express these, so the tests compare them with small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as al
from ..operators import folds as fo
from ..sources import sinks
from . import views
from .registry import register


def _words(spark, d):
    """Each segment's words, spread evenly over its span."""
    s = views.segments(spark, d).where("end > start")
    w = F.split(F.trim("text"), r"\s+")
    rows = s.select("media_id", F.col("pos").alias("line"), "start", "end", F.size(w).alias("n"), F.posexplode(w).alias("i", "text"))
    at = lambda k: F.round(F.col("start") + (F.col("end") - F.col("start")) * k / F.col("n"), 3)
    return rows.select("media_id", (F.col("line") * 10000 + F.col("i")).alias("pos"), at(F.col("i")).alias("start"), at(F.col("i") + 1).alias("end"), "text")


@register()
def normalized_timeline(spark, d):
    return fo.normalized_timeline(views.segments(spark, d))


@register()
def built_cues(spark, d):
    return fo.built_cues(_words(spark, d))


@register()
def merged_near_duplicates(spark, d):
    rows = views.intervals(spark, d).withColumnRenamed("label", "text")
    return fo.fold_rows(rows, lambda: fo.NearDuplicates(600.0), order=("start", "end", "pos"))


@register()
def merged_short_rows(spark, d):
    return fo.fold_rows(views.segments(spark, d), fo.ShortRows)


@register()
def polish_batches(spark, d):
    return fo.fold_rows(views.segments(spark, d), fo.Batches, "media_id long, pos long, start double, end double, text string, batch int", order=("start", "end", "pos"))


@register()
def spread_texts(spark, d):
    rows = views.segments(spark, d).where("trim(text) <> ''").select("media_id", "pos", (F.col("end") - F.col("start") + 5.0).alias("duration"), "text")

    def run(frames):
        for frame in frames:
            out = [(m, p, i, r["start"], r["end"], r["text"]) for m, p, t, x in zip(frame["media_id"], frame["pos"], frame["duration"], frame["text"]) for i, r in enumerate(fo.timed_parts(x, t))]
            yield frame.__class__(out, columns=["media_id", "pos", "part", "start", "end", "text"])

    return rows.mapInPandas(run, "media_id long, pos long, part int, start double, end double, text string")


@register()
def sequence_stats(spark, d):
    s = views.segments(spark, d)
    pairs = s.join(s.select("media_id", (F.col("pos") + 2).alias("pos"), F.col("text").alias("other")), ["media_id", "pos"])
    return pairs.select("media_id", "pos", al.sequence_stats("text", "other").alias("s")).select("media_id", "pos", "s.*")


@register()
def fused_transcripts(spark, d):
    s = views.segments(spark, d)
    lines = s.select("media_id", "pos", F.regexp_replace("text", "(?i)th", "Th").alias("text"))
    return al.fuse_per_media(_words(spark, d), lines, s)


@register(f"""
with {views.SEGMENTS}, b as (select media_id, pos, row_number() over (partition by media_id order by pos) as n, cast(round_even(start * 1000, 0) as bigint) as s, cast(round_even("end" * 1000, 0) as bigint) as e, text from segments)
select media_id, md5(string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', e // 3600000, e // 60000 % 60, e // 1000 % 60, e % 1000) || chr(10) || text || chr(10), chr(10) order by pos)) as document from b group by media_id
""")
def srt_documents(spark, d):
    return sinks.srt_documents(views.segments(spark, d)).select("media_id", F.md5("document").alias("document"))
