"""Streams over files give what the batch rule gives."""

import json
import os

import pytest

from tidemark.streaming import chunks


@pytest.fixture
def run(spark, tmp_path):
    def go(batches, schema, transform):
        src = tmp_path / "in"
        src.mkdir()
        for i, rows in enumerate(batches):
            (src / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
            os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        query = transform(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).collect()

    return go


def test_chunks_come_out_in_order(run):
    rows = [{"media_id": 1, "chunk": c, "text": f"t{c}"} for c in (1, 0, 3, 2, 1)]
    got = run([rows[:2], rows[2:4], rows[4:]], "media_id int, chunk int, text string", chunks.emit_in_order)
    assert sorted(r["chunk"] for r in got if not r["late"]) == [0, 1, 2, 3]
    assert [r["chunk"] for r in got if r["late"]] == [1]


def test_batches_end_after_their_seconds(run):
    rows = [{"media_id": 1, "start": 10.0 * i, "end": 10.0 * i + 10, "text": str(i)} for i in range(7)]
    got = run([rows[:4], rows[4:]], "media_id int, start double, end double, text string", chunks.batches)
    assert sorted((r["batch"], r["n"], r["end"]) for r in got) == [(0, 3, 30.0), (1, 3, 60.0)]


def test_the_last_batch_ends_with_its_media(run):
    rows = [{"media_id": m, "start": 100.0 + 10 * i, "end": 110.0 + 10 * i, "text": str(i)} for m in (1, 2) for i in range(4)]
    got = run([rows, [{"media_id": 1, "start": None, "end": None, "text": None}]], "media_id int, start double, end double, text string", chunks.batches)
    assert sorted((r["media_id"], r["batch"], r["n"], r["start"], r["end"]) for r in got) == [(1, 0, 3, 100.0, 130.0), (1, 1, 1, 130.0, 140.0), (2, 0, 3, 100.0, 130.0)]


def test_playback_has_two_thresholds(run):
    rows = [{"media_id": 1, "t": float(i), "buffered": b} for i, b in enumerate([5.0, 2.0, 5.0, 11.0, 4.0])]
    got = run([rows], "media_id int, t double, buffered double", chunks.playback)
    assert sorted((r["t"], r["state"]) for r in got) == [(1.0, "paused"), (3.0, "playing")]
