"""Readers of subtitle and recogniser files: one row a cue, with the file, its place and times in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

STAMP = r"\d{2}:\d{2}:\d{2},\d{3}"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modified, bytes, content) of whole text files, folders below included."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("content"))


def _rows(df: DataFrame, cues: Column) -> DataFrame:
    """(path, pos, start, end, text) of an array of struct(start, end, text); blank texts go."""
    rows = df.select("path", F.explode(F.array(cues)).alias("cues"))
    kept = F.filter("cues", lambda c: F.coalesce(c["text"], F.lit("")) != "")
    return rows.select("path", F.posexplode(kept).alias("pos", "c")).select("path", "pos", "c.start", "c.end", "c.text")


def srt(df: DataFrame) -> DataFrame:
    """Numbered blocks; tags go, lines are joined by a blank. A later line of digits only ends a block."""
    flat = F.regexp_replace("content", r"\r\n?", "\n")
    block = rf"(?m)^\s*\d+\s*\n({STAMP}\s+-->\s+{STAMP}[^\n]*\n(?s:.*?))(?=\n\s*\d+\s*\n|\z)"

    def cue(b: Column):
        lines = F.split(F.regexp_replace(F.regexp_replace(b, r"\A[^\n]*\n", ""), "<[^>]+>", ""), "\n")
        body = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), " ")
        stamps = F.regexp_extract_all(b, F.lit(f"({STAMP})"), F.lit(1))
        return F.struct(tx.srt_seconds(F.get(stamps, F.lit(0))).alias("start"), tx.srt_seconds(F.get(stamps, F.lit(1))).alias("end"), body.alias("text"))

    return _rows(df, F.transform(F.regexp_extract_all(flat, F.lit(block), F.lit(1)), cue))


def vtt(df: DataFrame) -> DataFrame:
    """Blocks with a time line; cue settings and tags go, entities are resolved."""
    flat = F.regexp_replace(F.regexp_replace("content", r"\r\n?", "\n"), r"(?m)^WEBVTT.*$", "")
    blocks = F.filter(F.split(flat, r"\n\s*\n"), lambda b: F.contains(b, F.lit("-->")))

    def cue(b: Column):
        timing = F.regexp_extract(b, r"(?m)^(.*-->.*)$", 1)
        side = lambda i: tx.vtt_seconds(F.get(F.split(F.trim(F.get(F.split(timing, "-->"), F.lit(i))), r"\s+"), F.lit(0)))
        body = F.regexp_replace(F.regexp_extract(b, r"(?s)-->[^\n]*\n?(.*)$", 1), "<[^>]+>", "")
        return F.struct(side(0).alias("start"), side(1).alias("end"), body.alias("text"))

    rows = _rows(df, F.transform(blocks, cue))
    return rows.withColumn("text", tx.single_spaced(tx.html_unescaped(F.col("text")))).where("text <> ''")


def plain(df: DataFrame) -> DataFrame:
    """A row for each non-blank line, a second each."""
    lines = F.filter(F.transform(F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _rows(df, F.transform(lines, lambda x, i: F.struct(i.cast("double").alias("start"), (i + 1).cast("double").alias("end"), x.alias("text"))))


def bracketed(df: DataFrame) -> DataFrame:
    """Lines ``[start - end] text``; control tags go."""
    line = r"(?m)^\[(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\]\s*(.+)$"
    found = F.regexp_extract_all("content", F.lit(line), F.lit(0))

    def cue(x: Column):
        part = lambda i: F.regexp_extract(x, line, i)
        return F.struct(part(1).cast("double").alias("start"), part(2).cast("double").alias("end"), tx.single_spaced(F.regexp_replace(part(3), r"<\|[^|>]+\|>", "")).alias("text"))

    return _rows(df, F.transform(found, cue))


READERS = {"srt": srt, "vtt": vtt, "txt": plain}


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """All subtitle files below a path by suffix; other files give no rows."""
    every = files(spark, path)
    out = None
    for suffix, reader in READERS.items():
        rows = reader(every.where(F.lower("path").endswith(f".{suffix}")))
        out = rows if out is None else out.unionByName(rows)
    return out


def silence_log(df: DataFrame) -> DataFrame:
    """(path, pos, start, end) of a detector's log; an open silence ends with the media (``duration``), a lone end began at 0."""
    marks = F.regexp_extract_all("content", F.lit(r"(silence_(?:start|end):\s*[0-9.]+)"), F.lit(1))
    rows = df.select("path", "duration", F.posexplode(marks).alias("i", "m"))
    rows = rows.select("path", "duration", "i", F.startswith(F.col("m"), F.lit("silence_start")).alias("opens"), F.regexp_extract("m", r"([0-9.]+)$", 1).cast("double").alias("t"))
    by = Window.partitionBy("path").orderBy("i")
    rows = rows.withColumn("was", F.lag("opens").over(by)).withColumn("before", F.lag("t").over(by)).withColumn("next", F.lead("opens").over(by))
    closed = rows.where(~F.col("opens")).select("path", F.col("i").alias("pos"), F.when(F.col("was"), F.col("before")).otherwise(0.0).alias("start"), F.col("t").alias("end"))
    left_open = rows.where(F.col("opens") & F.col("next").isNull()).select("path", F.col("i").alias("pos"), F.col("t").alias("start"), F.col("duration").alias("end"))
    return closed.unionByName(left_open)


def raw_blocks(df: DataFrame) -> DataFrame:
    """(path, number, start_stamp, end_stamp, text): numbered blocks as they stand, stamps as text; a blank line ends a block,
    and blocks without text go."""
    block = rf"(?m)^[ \t]*(\d+)[ \t]*\n({STAMP}) --> ({STAMP})[^\n]*\n((?:[^\n]*\S[^\n]*(?:\n|\z))+)"
    found = F.explode(F.regexp_extract_all(F.regexp_replace("content", r"\r\n?", "\n"), F.lit(block), F.lit(0)))
    part = lambda i: F.regexp_extract("b", block, i)
    return df.select("path", found.alias("b")).select("path", part(1).cast("int").alias("number"), part(2).alias("start_stamp"), part(3).alias("end_stamp"), F.regexp_replace(part(4), r"\A\s+|\s+\z", "").alias("text"))


def first_usable(rows: DataFrame, folder: str = "folder") -> DataFrame:
    """Of the files of a folder, the rows of the first by name that has any with text and a span; texts single-spaced."""
    good = rows.where("end > start").withColumn("text", tx.single_spaced(F.col("text"))).where("text <> ''")
    first = good.groupBy(folder).agg(F.min("path").alias("path"))
    return good.join(first, [folder, "path"], "left_semi")
