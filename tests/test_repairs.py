"""Filled times, reviews, raw blocks, text leaves and audits with warnings on small tables made here."""

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import audit as au
from tidemark.operators import evidence as ev
from tidemark.operators import state as st
from tidemark.sources import subtitles

ROWS = "media_id long, pos int, start double, end double, text string"


def test_filled_times(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, None), (1, 4, 5.0), (1, 5, None), (2, 0, None)], "media_id long, pos int, t double")
    got = [r.t for r in ev.filled_times(rows).orderBy("media_id", "pos").collect()]
    assert got == [2.0, 2.0, 3.0, 4.0, 5.0, 5.0, None]


def test_better_of(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.0, "ab"), (2, 0, 0.0, 1.0, "ab"), (3, 0, 0.0, 1.0, "ab"), (4, 0, 0.0, 1.0, "a")], ROWS)
    review = spark.createDataFrame([(1, 0, 0.0, 1.0, "xy"), (2, 0, 0.0, 1.0, "x"), (3, 0, 0.0, 1.0, "long text"), (5, 0, 0.0, 1.0, "new")], ROWS)
    got = {r.media_id: r.text for r in au.better_of(rows, review, spark.createDataFrame([(3,)], "media_id long")).collect()}
    assert got == {1: "xy", 2: "ab", 3: "ab", 4: "a", 5: "new"}


def test_raw_blocks_and_first_usable(spark):
    content = "1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>one</i>\r\ntwo \r\n\r\n2\n00:00:03,000 --> 00:00:04,000\n\n3\n00:00:05,000 --> 00:00:06,000\n7 swans\n"
    rows = subtitles.raw_blocks(spark.createDataFrame([("f", content), ("g", None), ("h", "")], "path string, content string"))
    assert [tuple(r) for r in rows.orderBy("number").collect()] == [("f", 1, "00:00:01,000", "00:00:02,500", "<i>one</i>\ntwo"), ("f", 3, "00:00:05,000", "00:00:06,000", "7 swans")]
    cues = spark.createDataFrame([("d", "a", 0, 1.0, 1.0, "no span"), ("d", "b", 0, 0.0, 1.0, " x  y "), ("d", "c", 0, 0.0, 1.0, "late"), ("e", "a", 0, 0.0, 1.0, " ")], "folder string, path string, pos int, start double, end double, text string")
    assert [(r.folder, r.path, r.text) for r in subtitles.first_usable(cues).collect()] == [("d", "b", "x y")]


def test_text_leaves_and_newest(spark):
    replies = spark.createDataFrame([('{"other": {"type": "text", "text": "no"}, "steps": [{"type": "text", "text": "a"}, [{"k": {"type": "text", "text": "b"}}, {"type": "text", "text": 3}]]}',), ("broken",), (None,), ("3",)], "x string")
    assert [r[0] for r in replies.select(tx.text_leaves(F.col("x"))).collect()] == ["a\nb", "", "", ""]
    files = spark.createDataFrame([("d", "a", 1), ("d", "b", 3), ("d", "c", 3), ("d", "n", None)], "folder string, path string, modified long")
    assert [(r.path, r.place) for r in st.newest(files, 2, "modified", "path", keys=["folder"]).orderBy("place").collect()] == [("c", 1), ("b", 2)]


def test_audit_tells_warnings_and_regions(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 4.0, "a calm sentence of words"), (2, 0, 0.0, 4.0, "another calm sentence here"), (3, 0, 0.0, 10.0, "hm")], ROWS)
    warned = spark.createDataFrame([(1,), (3,)], "media_id long")
    got = {r.media_id: r.status for r in au.audit(rows, rows, warnings=warned).collect()}
    assert got == {1: "passed_with_warnings", 2: "passed", 3: "incomplete_speech_coverage"}
    regions = au.audit_regions(rows, rows.withColumn("end", F.col("end") + F.when(F.col("media_id") == 2, 5.0).otherwise(0.0))).collect()
    assert {(r.media_id, r.kind) for r in regions} == {(2, "uncovered"), (3, "suspicious")}
    assert "low text density" in {r.reason for r in regions if r.media_id == 3}.pop()
