"""Streams of capture sessions and of a manifest, over files, with restarts and repeated batches."""

import json
import os

import pytest

from tidemark.streaming import sessions

CHUNKS = "session_id int, chunk int, segments array<struct<start:double,end:double,text:string>>, at timestamp"


@pytest.fixture
def source(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(i, rows):
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))

    return put, lambda schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))


def chunk(session, k, *texts, at="2024-01-01 00:00:00"):
    return {"session_id": session, "chunk": k, "segments": None if texts == (None,) else [{"start": 0.5 * i, "end": 0.5 * i + 0.4, "text": t} for i, t in enumerate(texts)], "at": at}


def drained(stream, tmp_path, name):
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-cp")).option("path", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)


def test_first_and_more_over_restarts(spark, source, tmp_path):
    put, read = source
    put(0, [chunk(1, 0, " "), chunk(1, 1, "a", "b"), chunk(2, 0, None)])
    put(1, [chunk(1, 3, "d"), chunk(1, 2, "c"), chunk(2, 1, "x")])
    drained(sessions.captions(sessions.captured(read(CHUNKS))), tmp_path, "out")
    put(2, [chunk(1, 4, "e"), chunk(2, 2, None), chunk(2, 3, "y")])
    drained(sessions.captions(sessions.captured(read(CHUNKS))), tmp_path, "out")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "first", 1, 2, "a b"), (1, "more", 2, 1, "c"), (1, "more", 3, 1, "d"), (1, "more", 4, 1, "e"), (2, "first", 1, 1, "x"), (2, "more", 3, 1, "y")]


def test_idle_sessions_are_forgotten(spark, source, tmp_path):
    put, read = source
    put(0, [chunk(1, 0, "a", at="2024-01-01 00:00:00")])
    put(1, [chunk(2, 0, "b", at="2024-01-01 05:00:00")])
    put(2, [chunk(3, 0, "c", at="2024-01-01 05:30:00")])
    put(3, [chunk(1, 1, "again", at="2024-01-01 06:00:00"), chunk(2, 1, "still", at="2024-01-01 05:40:00")])
    stream = read(CHUNKS).withWatermark("at", "1 minute")
    rows = stream.selectExpr("session_id", "chunk", "at", "inline(segments)").selectExpr("session_id", "chunk", "start", "end", "text", "at")
    drained(sessions.captions(rows, idle="1 hour"), tmp_path, "out")
    got = sorted((r["session_id"], r["chunk"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, "first"), (1, 1, "first"), (2, 0, "first"), (2, 1, "more"), (3, 0, "first")]


def test_snapshots_keep_each_batch_once(spark, source, tmp_path):
    put, read = source
    put(0, [chunk(1, 0, "a", "b")])
    put(1, [chunk(1, 2, "d"), chunk(1, 4, None), chunk(2, 0, " ")])
    path = str(tmp_path / "kept")
    for n in range(2):  # the second time without its checkpoint: both batches run again
        sessions.write_snapshots(sessions.captured(read(CHUNKS)), path, str(tmp_path / f"cp{n}"), availableNow=True).awaitTermination(120)
    rows = sessions.snapshot(spark, path)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, 0.0, 0.4, "a"), (1, 0, 0.5, 0.9, "b"), (1, 2, 6.0, 6.4, "d")]
    chunks = spark.createDataFrame([(1, 0), (1, 2), (1, 4), (2, 0)], "session_id int, chunk int")
    assert sorted(tuple(r) for r in sessions.manifests(chunks, rows).collect()) == [(1, 5, 15.0, 3.0, 3, "a\nb\nd"), (2, 1, 3.0, 3.0, 0, "")]


def test_manifest_items_are_given_once(spark, source, tmp_path):
    put, read = source
    schema = "slug string, seq long, asr_done boolean, polished_done boolean, has_result boolean, path string"
    row = lambda slug, seq, asr, polished, result: {"slug": slug, "seq": seq, "asr_done": asr, "polished_done": polished, "has_result": result, "path": slug + ".mp4"}
    put(0, [row("a", 1, False, None, False), row("b", 1, True, True, True), row("c", 1, True, None, False)])
    put(1, [row("a", 3, True, False, True), row("a", 2, True, False, False), row("b", 2, True, False, True)])
    put(2, [row("a", 4, True, None, True), row("c", 1, True, None, True), row("c", 2, True, None, True)])
    drained(sessions.ready_items(read(schema)), tmp_path, "out")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "a.mp4", 3), ("c", "c.mp4", 2)]
