"""The driver's tables as timelines: each view as a DataFrame and as SQL. Times are whole milliseconds divided by 1000."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments: a turn lasts a second for 15 characters; starts are moved so that gaps and overlaps both occur."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    ms = F.floor(F.length("text") * 1000 / 15).cast("long")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.element_at(F.array(*map(F.lit, (0, 700, -900, 2500, -300))), (F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(5)) + 1).cast("int"))
    start = F.greatest(F.lit(0), F.coalesce(F.sum("ms").over(before), F.lit(0)) + shift)
    rows = turns.withColumn("ms", ms).withColumn("start_ms", start)
    return rows.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("pos"), (F.col("start_ms") / 1000).alias("start"), ((F.col("start_ms") + F.col("ms")) / 1000).alias("end"), "text")


SEGMENTS = """
seg_ms as (select conv_id, turn, coalesce(text, '') as text, cast(floor(length(coalesce(text, '')) * 1000 / 15) as bigint) as ms from conversations),
seg_at as (
  select conv_id, turn, text, ms,
    greatest(0, cast(coalesce(sum(ms) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) + [0, 700, -900, 2500, -300][(conv_id * 7 + turn * 3) % 5 + 1]) as start_ms
  from seg_ms),
segments as (select conv_id as media_id, turn as pos, start_ms / 1000.0::double as start, (start_ms + ms) / 1000.0::double as "end", text from seg_at)
"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled intervals of a user: value minutes times ten."""
    events = table(spark, sf_dir, "events").where("ts is not null and value is not null")
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    end = start + F.round(F.col("value") * 100).cast("long") * 6000
    return events.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("pos"), (start / 1000).alias("start"), (end / 1000).alias("end"), F.col("event_type").alias("label"))


INTERVALS = """
intervals as (
  select user_id as media_id, event_id as pos, (epoch_us(ts) // 1000) / 1000.0::double as start,
    ((epoch_us(ts) // 1000) + cast(round(value * 100) as bigint) * 6000) / 1000.0::double as "end", event_type as label
  from events where ts is not null and value is not null)
"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a thread: turn 0 is the root; an odd turn answers the root, an even one the turn before."""
    turns = table(spark, sf_dir, "conversations")
    node = F.col("conv_id") * 1000 + F.col("turn") + 1
    parent = F.when(F.col("turn") == 0, F.lit(None)).when(F.col("turn") % 2 == 1, F.col("conv_id") * 1000 + 1).otherwise(node - 1)
    return turns.select(F.col("conv_id").alias("thread_id"), node.alias("node_id"), parent.cast("long").alias("parent_id"), F.col("role").alias("author"), F.col("text"))


TREE = """
tree as (
  select conv_id as thread_id, conv_id * 1000 + turn + 1 as node_id,
    case when turn = 0 then null when turn % 2 = 1 then conv_id * 1000 + 1 else conv_id * 1000 + turn end as parent_id, role as author, text
  from conversations)
"""
