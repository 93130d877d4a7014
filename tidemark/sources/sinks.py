"""Writers: subtitle documents, plain and stamped text, JSON caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def _joined(df: DataFrame, line: Column, key: str, separator: str) -> DataFrame:
    """(key, document): the lines of each key in order of pos."""
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return df.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), separator).alias("document"))


def srt_documents(df: DataFrame, key: str = "media_id", separator: str = "\n") -> DataFrame:
    """Numbered blocks of each media, numbered from 1 in order of pos."""
    lines = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text")))
    block = F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit("\n"), tx.srt_time(r["start"]), F.lit(" --> "), tx.srt_time(r["end"]), F.lit("\n"), r["text"], F.lit("\n")))
    return df.groupBy(key).agg(lines.alias("rows")).select(key, F.array_join(block, separator).alias("document"))


def text_documents(df: DataFrame, key: str = "media_id", stamped: bool = False) -> DataFrame:
    """Non-blank texts, one a line; stamped=True puts [start - end] before them."""
    line = F.format_string("[%s - %s] %s", tx.clock(F.col("start"), False), tx.clock(F.col("end"), False), F.col("text")) if stamped else F.col("text")
    return _joined(df.where(F.trim("text") != ""), line, key, "\n")


def json_documents(df: DataFrame, key: str = "media_id") -> DataFrame:
    """Version-2 cache: the segments as JSON."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text")))
    segments = F.transform("rows", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text")))
    return df.groupBy(key).agg(rows.alias("rows")).select(key, F.to_json(F.struct(F.lit(2).alias("schema_version"), segments.alias("segments"))).alias("document"))


def write_documents(df: DataFrame, path: str, key: str = "media_id") -> None:
    """One text file a key, in a folder of its own."""
    df.select(key, "document").write.mode("overwrite").partitionBy(key).text(path)


def without_phrases(df: DataFrame, phrases: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose text isn't one of the listed phrases; blank phrases and those after # don't count."""
    listed = phrases.select(F.trim("phrase").alias("_p")).where("_p <> '' and _p not like '#%'").distinct()
    return df.join(listed, F.trim(F.col(column)) == F.col("_p"), "left_anti")
