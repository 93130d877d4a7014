"""Report metrics: error rates by rate, consensus, recommendation, batch roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consensus(df: DataFrame, keys: list[str], rate: str = "rate", text: str = "text", anchors: int = 3) -> DataFrame:
    """The text that most of the ``anchors`` highest rates agree on; of equals, that of the highest rate."""
    by = Window.partitionBy(*keys).orderBy(F.desc(rate))
    top = df.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= anchors)
    votes = top.groupBy(*keys, text).agg(F.count(F.lit(1)).alias("votes"), F.max(rate).alias("_best"))
    return votes.groupBy(*keys).agg(F.max_by(F.struct(text, "votes"), F.struct("votes", "_best")).alias("_t")).select(*keys, "_t.*")


def error_rates(df: DataFrame, reference: DataFrame, keys: list[str], rate: str = "rate", stable: float = 0.01) -> DataFrame:
    """By rate: edits, characters, aggregate and largest error rate, exact texts, and whether the rate is stable."""
    rows = df.join(reference.select(*keys, F.col("text").alias("_ref")), keys)
    rows = rows.withColumn("_d", F.levenshtein("text", "_ref")).withColumn("_n", F.length("_ref"))
    one = F.when(F.col("_n") > 0, F.col("_d") / F.col("_n")).otherwise(F.when(F.col("_d") > 0, 1.0).otherwise(0.0))
    out = rows.groupBy(rate).agg(F.sum("_d").alias("edits"), F.sum("_n").alias("chars"), F.max(one).alias("max_rate"), F.count_if(F.col("_d") == 0).alias("exact"), F.count(F.lit(1)).alias("n"))
    total = F.when(F.col("chars") > 0, F.col("edits") / F.col("chars")).otherwise(0.0)
    return out.withColumn("error_rate", total).withColumn("stable", (total <= stable) & (F.col("max_rate") <= 2 * stable))


def recommended(df: DataFrame, keys: list[str], rate: str = "rate", margin: int = 1) -> DataFrame:
    """(floor, advised) of the stable rates: the lowest, and the one ``margin`` steps above it if there is one."""
    rows = df.where("stable").groupBy(*keys).agg(F.array_sort(F.collect_set(rate)).alias("_r")) if keys else df.where("stable").agg(F.array_sort(F.collect_set(rate)).alias("_r"))
    return rows.select(*keys, F.get("_r", F.lit(0)).alias("floor"), F.get("_r", F.least(F.size("_r") - 1, F.lit(margin))).alias("advised"))


def straggler_limit(df: DataFrame, keys: list[str], order: str, seconds: str = "seconds", first: int = 3, least: float = 10.0, factor: float = 1.5) -> DataFrame:
    """Seconds beyond which a task is split: ``factor`` times the fastest of the first few, at least ``least``."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= first)
    return rows.groupBy(*keys).agg(F.greatest(F.lit(least), F.min(seconds) * factor).alias("limit"))


def nth_percentile(values, share: float = 0.9):
    """The value at place int(share * n) - 1 of the sorted values, the first for few."""
    s = F.array_sort(values)
    return F.get(s, F.greatest(F.lit(0), F.floor(F.size(s) * share).cast("int") - 1))


def error_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median, 90th percentile and maximum of absolute errors by key."""
    v = F.abs(F.col(value))
    return df.groupBy(key).agg(F.median(v).alias("median"), nth_percentile(F.collect_list(v)).alias("p90"), F.max(v).alias("largest"), F.count(F.lit(1)).alias("n"))


def roll_up(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    count = lambda s: F.count_if(F.col(status) == s).alias(s)
    return df.groupBy(*keys).agg(count("completed"), count("skipped"), count("failed"))
