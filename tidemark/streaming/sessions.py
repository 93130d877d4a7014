"""Capture sessions as streams: chunks put on the session's time, first and further captions, snapshots, manifest watching.

State is a few typed columns a key: whether a session has begun and its last chunk; how far an item has come. With a
watermark on ``at`` a session that is idle for a while is forgotten. Snapshots are written a folder a batch, so a batch that
runs again after a failure overwrites what it wrote and adds nothing twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def captured(chunks: DataFrame, seconds: float = 3.0, key: str = "session_id") -> DataFrame:
    """(key, chunk, start, end, text) of chunks (key, chunk, segments array<struct<start,end,text>>) that lie side by side, each
    ``seconds`` long; a stream or a table. Null segments are a failed chunk and blank texts no captions; both give no rows."""
    rows = chunks.select(key, "chunk", F.inline("segments"))
    offset = F.col("chunk") * F.lit(float(seconds))
    return rows.where("trim(text) <> ''").select(key, "chunk", (F.col("start") + offset).alias("start"), (F.col("end") + offset).alias("end"), F.trim("text").alias("text"))


def captions(rows: DataFrame, idle: str | None = None, key: str = "session_id") -> DataFrame:
    """(key, kind, chunk, n, text): the captions of each chunk that has some, as "first" for the session's first one and "more"
    behind it; a trigger's chunks in order. A chunk that comes behind a later one is "more" as well.

    rows are what ``captured`` gives of a stream; with ``idle``, such as "1 hour", they have a watermarked time ``at``, and a
    session without rows for so long is over: what comes then begins anew.
    """
    out = f"{key} {dict(rows.dtypes)[key]}, kind string, chunk int, n int, text string"
    gap = pd.Timedelta(idle).value // 1_000_000 if idle else None

    def run(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        begun, last = state.get if state.exists else (False, -1)
        whole = pd.concat(list(frames))
        made = []
        for chunk, own in whole.sort_values(["chunk", "start", "end"], kind="stable").groupby("chunk", sort=True):
            made.append((keys[0], "more" if begun else "first", int(chunk), len(own), " ".join(own["text"])))
            begun, last = True, max(last, int(chunk))
        state.update((begun, last))
        if gap is not None:
            newest = int(pd.Timestamp(whole["at"].max()).timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + gap)
        yield pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")])

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, out, "begun boolean, last int", "append", timeout)


def ready_items(changes: DataFrame, key: str = "slug") -> DataFrame:
    """(key, path, seq) of each item once, when it has its recognition (``asr_done`` and ``has_result``) and isn't finished.

    changes (key, seq, asr_done, polished_done, has_result, path) is the log of a manifest; a trigger's rows of an item count
    in order of seq, and what comes behind a later seq changes nothing. An item that is finished is never given.
    """
    out = f"{key} {dict(changes.dtypes)[key]}, path string, seq long"

    def run(keys, frames, state):
        seen, given = state.get if state.exists else (-1, False)
        made = []
        for row in pd.concat(list(frames)).sort_values("seq", kind="stable").to_dict("records"):
            if row["seq"] <= seen:
                continue
            seen = int(row["seq"])
            if row["polished_done"] is True:
                given = True
            elif not given and row["asr_done"] is True and row["has_result"] is True:
                given = True
                made.append((keys[0], row["path"], seen))
        state.update((seen, given))
        yield pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")])

    return changes.groupBy(key).applyInPandasWithState(run, out, "seen long, given boolean", "append", GroupStateTimeout.NoTimeout)


def write_snapshots(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A query that keeps every batch of ``rows`` at path/batch=<id>; the same batch again takes its own folder's place."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """What the batches have kept so far."""
    return spark.read.parquet(path).drop("batch")


def manifests(chunks: DataFrame, rows: DataFrame, seconds: float = 3.0, key: str = "session_id") -> DataFrame:
    """(key, num_chunks, duration_seconds, chunk_seconds, num_segments, transcript) of each session: chunks count up to the
    last one, failed ones too; the transcript has a caption a line."""
    n = chunks.groupBy(key).agg((F.max("chunk") + 1).alias("num_chunks"))
    text = rows.groupBy(key).agg(F.count(F.lit(1)).alias("num_segments"), F.array_sort(F.collect_list(F.struct("start", "end", "chunk", "text"))).alias("_s"))
    lines = F.array_join(F.transform("_s", lambda s: s["text"]), "\n")
    return n.join(text, key, "left").select(key, "num_chunks", (F.col("num_chunks") * F.lit(float(seconds))).alias("duration_seconds"), F.lit(float(seconds)).alias("chunk_seconds"), F.coalesce("num_segments", F.lit(0).cast("long")).alias("num_segments"), F.coalesce(lines, F.lit("")).alias("transcript"))
