"""Rows made for or from chunks: texts spread over time, sampling plans, frames, corrections, chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv

KEY = "media_id"


def spread_by_weight(df: DataFrame, weight: str = "weight", duration: str = "duration", key: str = KEY) -> DataFrame:
    """Rows in order of pos share [0, duration] in proportion to their weights; the last ends at the duration exactly."""
    by = Window.partitionBy(key).orderBy("pos")
    total = F.sum(weight).over(Window.partitionBy(key))
    upto = F.sum(weight).over(by.rowsBetween(Window.unboundedPreceding, 0))
    end = F.when(upto == total, F.col(duration)).otherwise(F.col(duration) * upto / total)
    return df.withColumn("start", F.col(duration) * (upto - F.col(weight)) / total).withColumn("end", end)


def tasks(media: DataFrame, seconds: float, key: str = KEY) -> DataFrame:
    """Tumbling tasks of ``seconds``; the last may be shorter."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / seconds)).cast("int")
    rows = media.select(key, "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("task"))
    return rows.select(key, "task", (F.col("task") * seconds).alias("start"), F.least(F.lit(seconds), F.col("duration") - F.col("task") * seconds).alias("duration"))


def sampling_plan(df: DataFrame, longest: float = 8.0, edge: float = 2.0, fine: float = 4.0, coarse: float = 1.0, key: str = KEY) -> DataFrame:
    """Windows to sample: a long one as edge, body, edge with two frame rates, a short one whole; with the frames each takes."""
    part = lambda s, e, fps: F.struct(s.alias("start"), e.alias("end"), F.lit(fps).alias("fps"))
    s, e = F.col("start"), F.col("end")
    parts = F.when(e - s > longest, F.array(part(s, s + edge, fine), part(s + edge, e - edge, coarse), part(e - edge, e, fine))).otherwise(F.array(part(s, e, fine)))
    rows = df.select(key, "pos", F.posexplode(parts).alias("part", "w")).select(key, "pos", "part", "w.*")
    return rows.withColumn("frames", F.ceil((F.col("end") - F.col("start")) * F.col("fps")).cast("int"))


def frame_times(plan: DataFrame, key: str = KEY) -> DataFrame:
    """(key, pos, part, frame, t): start + frame / fps."""
    rows = plan.where("frames > 0").withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)))
    return rows.select(key, "pos", "part", "frame", F.round(F.col("start") + F.col("frame") / F.col("fps"), 6).alias("t"))


def keep_last(df: DataFrame, order: str = "file_no", key: str = KEY) -> DataFrame:
    """Of rows with equal text and stamps to two places, the one of the last file."""
    by = Window.partitionBy(key, F.bround("start", 2), F.bround("end", 2), "text").orderBy(F.desc(order), F.desc("pos"))
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def unclipped(df: DataFrame, chunk: float, slack: float = 30.0, key: str = KEY) -> DataFrame:
    """Chunks (column ``chunk``) whose stamps all lie within one chunk's length count from their own start and are shifted;
    the first chunk never is."""
    top = F.max("end").over(Window.partitionBy(key, "chunk"))
    shift = F.when((F.col("chunk") > 0) & (top <= chunk + slack), F.col("chunk") * chunk).otherwise(0.0)
    return df.withColumn("_shift", shift).withColumn("start", F.col("start") + F.col("_shift")).withColumn("end", F.col("end") + F.col("_shift")).drop("_shift")


def corrected(df: DataFrame, corrections: DataFrame, size: int, key: str = KEY) -> DataFrame:
    """Texts replaced by corrections (key, batch, line, text) of batches of ``size`` rows; rows without one keep theirs."""
    named = corrections.select(key, (F.col("batch") * size + F.col("line")).alias("pos"), F.col("text").alias("_new"))
    return df.join(named, [key, "pos"], "left").withColumn("text", F.coalesce(F.nullif(F.trim("_new"), F.lit("")), F.col("text"))).drop("_new").select(*df.columns)


def kept_enough(df: DataFrame, polished: DataFrame, share: float = 0.8, key: str = KEY) -> DataFrame:
    """(key, ok): the polished rows keep ``share`` of the rows and of the characters."""
    size = lambda d, p: d.groupBy(key).agg(F.count(F.lit(1)).alias(f"{p}n"), F.sum(F.length("text")).alias(f"{p}c"))
    both = size(df, "a").join(size(polished, "b"), key, "left")
    return both.select(key, F.coalesce((F.col("bn") >= share * F.col("an")) & (F.col("bc") >= share * F.col("ac")), F.lit(False)).alias("ok"))


def chapter_at(probes: DataFrame, chapters: DataFrame, time: str = "t", key: str = KEY) -> DataFrame:
    """probes with ``chapter``: the last one that started; before the first, the first."""
    marks = chapters.select(key, "start", F.col("start").alias("end"), F.col("chapter").alias("pos"))
    first = marks.groupBy(key).agg(F.min_by("pos", F.struct("start", "pos")).alias("_first"))
    seen = iv.as_of(probes, marks, time, key, until_end=False).join(first, key, "left")
    return seen.select(*probes.columns, F.coalesce("current", "_first").alias("chapter"))


def with_chapter_marks(df: DataFrame, chapters: DataFrame, slack: float = 0.5, key: str = KEY) -> DataFrame:
    """Rows with the marks of chapters before their texts, each on the first row that starts at it or later.

    Chapters after every row stand on one row of three seconds of their own, at the last of them.
    """
    at = iv.first_at_or_after(chapters.select(key, "start", "title"), df, "start", slack, key).withColumnRenamed("next", "pos").distinct()
    mark = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "title"))), lambda c: F.concat(F.lit("["), c["title"], F.lit("]"))), "\n")
    marks = at.groupBy(key, "pos").agg(mark.alias("_mark"), F.max("start").alias("_start"))
    hit = df.join(marks.where("pos is not null").drop("_start"), [key, "pos"], "left").withColumn("text", F.concat_ws("\n", "_mark", "text")).select(*df.columns)
    late = marks.where("pos is null").select(key, F.lit(None).cast(df.schema["pos"].dataType).alias("pos"), F.col("_start").alias("start"), (F.col("_start") + 3.0).alias("end"), F.col("_mark").alias("text"))
    return hit.unionByName(late)


def grouped_frames(df: DataFrame, fps: float, similar, least: float = 0.72, key: str = KEY) -> DataFrame:
    """Frames with ``cue``: a new one begins after a gap over max(1, 2 / fps) or where ``similar(text, before)`` falls under
    ``least``. ``similar`` makes a column of two columns."""
    by = Window.partitionBy(key).orderBy("timestamp")
    rows = df.withColumn("_t", F.lag("timestamp").over(by)).withColumn("_x", F.lag("text").over(by))
    rows = rows.withColumn("_like", similar(F.col("text"), F.coalesce("_x", F.lit(""))))
    begins = F.col("_t").isNull() | (F.col("timestamp") - F.col("_t") > max(1.0, 2 / fps)) | (F.col("_like") < least)
    return rows.withColumn("cue", F.sum(begins.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_t", "_x", "_like")


def representative(df: DataFrame, key: str = KEY) -> DataFrame:
    """(key, cue, start, end, text, variants): the surest text (to two places), then the longest, then the first."""
    best = F.struct(F.round("confidence", 2).alias("c"), F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]+", "")).alias("n"), (-F.col("timestamp")).alias("t"))
    return df.groupBy(key, "cue").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.max_by("text", best).alias("text"), F.array_sort(F.collect_set("text")).alias("variants"))
