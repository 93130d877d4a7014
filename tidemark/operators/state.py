"""Keyed state tables: upserts, latest rows, preferred rows, byte budgets, readiness, pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, by the order columns; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order (columns or expressions)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], created: str | None = None) -> DataFrame:
    """table with the changes' non-null values; ``created`` keeps the older value. Both sides have one row a key."""
    c = changes.select(*[F.col(x).alias(x if x in keys else f"_{x}") for x in changes.columns])
    both = table.join(c, keys, "full_outer")
    value = lambda x: F.coalesce(F.col(x), F.col(f"_{x}")) if x == created else F.coalesce(F.col(f"_{x}"), F.col(x))
    return both.select(*keys, *[(value(x) if f"_{x}" in c.columns else F.col(x)).alias(x) for x in table.columns if x not in keys])


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def over_budget(entries: DataFrame, most: int, group: list[str], keep: Column | None = None, size: str = "bytes", used: str = "last_used", tie: str = "path") -> DataFrame:
    """Entries to remove, oldest first, until a group's bytes are within ``most``; ``keep`` marks entries that stay."""
    total = F.sum(size).over(Window.partitionBy(*group))
    rows = entries.withColumn("_total", total)
    if keep is not None:
        rows = rows.where(~keep)
    before = Window.partitionBy(*group).orderBy(used, tie).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(size).over(before), F.lit(0))
    return rows.withColumn("_left", F.col("_total") - gone).where(F.col("_left") > most).drop("_total", "_left")


def ready(stages: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """stages (keys, stage, status, artifacts array<string>) with ``ready``: completed and every artifact has bytes."""
    listed = stages.select(*keys, "stage", F.explode_outer("artifacts").alias("path"))
    sized = listed.join(files.select("path", "bytes"), "path", "left")
    have = sized.groupBy(*keys, "stage").agg(F.min(F.when(F.col("path").isNull(), 1).otherwise(F.coalesce("bytes", F.lit(0)))).alias("_least"))
    return stages.join(have, [*keys, "stage"]).withColumn("ready", (F.col("status") == "completed") & (F.col("_least") > 0)).drop("_least")


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items that the materialised results lack: only missing work is computed again."""
    return items.join(done.select(*keys), keys, "left_anti")


def admission(busy: Column, free_mb: Column, need_mb: Column, load: Column, most_load: float = 85.0) -> Column:
    """Verdict of a rule ladder over a snapshot row; unknown figures (below 0) don't refuse."""
    return F.when(busy, "busy").when((free_mb >= 0) & (free_mb < need_mb), "memory").when((load >= 0) & (load > most_load), "load").otherwise("admit")


def refreshed_status(status: Column, path: Column, exists: Column) -> Column:
    """A ready entry whose file is gone is pruned; an unknown status failed."""
    known = F.when(status.isin("queued", "running", "ready", "failed", "audio_cache_pruned"), status).otherwise("failed")
    return F.when((known == "ready") & (F.coalesce(path, F.lit("")) != "") & ~F.coalesce(exists, F.lit(False)), "audio_cache_pruned").otherwise(known)


def newest(df: DataFrame, n: int, modified: str, *ties: str, keys: list[str]) -> DataFrame:
    """df with ``place``: the ``n`` latest rows of each group, later ties first; rows without a time come last."""
    by = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(modified), *[F.desc(t) for t in ties])
    return df.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)
