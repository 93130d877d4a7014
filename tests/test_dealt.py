"""What is dealt between tasks grows with the texts' own bytes: no lists of characters, no row a character, no product of a media."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import slices
from tidemark.functions import text as tx
from tidemark.operators import anchors as an
from tidemark.operators import audit
from tidemark.operators import patches as pt
from tidemark.plans import texts
from tidemark.plans.registry import ORACLES

LINES = "media_id long, pos int, start double, end double, text string, chunk int"


def lines(spark, n=40, swap="q"):
    rows = [(m, i, float(i), i + 0.9, f"Line {i * 7919 % 1000} of {m}, né {i * i} ﬁ {swap} {'wide ' * (i % 9)}" * (1 + 20 * (i == 7)), i // 5) for m in range(3) for i in range(n)]
    return spark.createDataFrame(rows, LINES)


def test_held_characters_are_short_texts(spark):
    held = an.held(lines(spark))
    assert not any(isinstance(f.dataType, T.ArrayType) for f in held.schema)
    sizes = [len(r["text"]) for r in held.collect()]
    assert max(sizes) <= 256 and sum(sizes) > 20 * len(sizes)


def test_matched_characters_are_dealt_as_stretches(spark):
    left, right = lines(spark), lines(spark, swap="x")
    chunks = an.timed_report(left, right, left.groupBy("media_id").agg({"end": "max"}).toDF("media_id", "duration"))[1]
    plan = chunks._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    made = [i for i, line in enumerate(plan) if "Generate explode" in line]
    assert made
    for i in made:  # nothing above it deals its rows before they are summed
        above, d = [], depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < d:
                above.append(line)
                d = depth(line)
        first = next(k for k, line in enumerate(above) if "Aggregate" in line)
        assert not any("Exchange" in line for line in above[:first])


def test_long_texts_have_the_same_blocks(spark, monkeypatch):
    left, right = an.held(lines(spark)), an.held(lines(spark, swap="x"))
    want = sorted(map(tuple, an.aligned_blocks(left, right).collect()))
    monkeypatch.setattr(an, "LONG", 10)
    assert want and sorted(map(tuple, an.aligned_blocks(left, right).collect())) == want


def test_evidence_is_read_in_slices():
    text = pd.Series(["Né ﬁ 1", "ab", None, ""] * 60)
    kept = list(pt._kept.func(iter([text])))
    assert [k for part in kept for k in part] == ["néfi1", "ab", "", ""] * 60 and max(map(len, kept)) <= slices.ROWS
    scores = list(pt._score.func(iter([(pd.Series(["abcd"] * 200), pd.Series(["abxd"] * 200))])))
    assert [x for part in scores for x in part] == [0.75] * 200 and max(map(len, scores)) <= slices.ROWS


def test_dominant_phrases_leave_their_rows_only_where_ids_repeat(spark, tmp_path):
    rng = random.Random(3)
    text = lambda share, n: ", ".join("over" if rng.random() < share else f"word{rng.randrange(9)}{'x' * rng.randrange(9)}" for _ in range(n))
    rows = [(i, text(rng.choice([0.2, 0.55, 0.6, 0.7, 1.0]), rng.randrange(8, 60))) for i in range(300)] + [(400, "one。" * 60), (401, "x" * 25 + "。" + ("x" * 25 + "，") * 30), (402, None), (403, "la la! " * 40)]
    for name, all_rows in (("once", rows), ("again", rows + [(7, rows[3][1]), (None, "la! " * 60), (None, "la? " * 60), (400, "one。" * 60)])):
        spark.createDataFrame(all_rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = texts.dominant_phrases(spark, f"{tmp_path}/{name}")
        con = duckdb.connect()
        con.sql(f"create view documents as select * from read_parquet('{tmp_path}/{name}/documents.parquet/*.parquet')")
        want = con.sql(ORACLES["dominant_phrases"]).fetchall()
        assert len(want) > 50 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (name == "again")


def test_the_gate_splits_a_text_once(spark):
    rng = random.Random(4)
    rows = [(i, ", ".join("over" if rng.random() < share else f"word{rng.randrange(9)}{'x' * rng.randrange(30)}" for _ in range(n))) for i in range(200) for share, n in [(rng.choice([0, 0.55, 0.6, 0.65, 1.0]), rng.randrange(5, 60))]]
    df = spark.createDataFrame(rows + [(500, None), (501, ""), (502, "la " * 60), (503, "x" * 25 + (", " + "x" * 25) * 20), (504, " ，" * 90)], "media_id long, text string")
    got = tx.phrase_filled(df)
    assert got.columns == df.columns
    want = {r["media_id"] for r in df.where(tx.dominant_phrase(F.col("text")).isNotNull()).collect()}
    assert len(want) > 20 and {r["media_id"] for r in got.collect()} == want
    assert audit.table_issue(df)._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
