"""Benchmark items with a null id, against the query's SQL."""

import duckdb
import pytest

from tidemark.llm import decontaminate, queries

SECRET = " ".join(f"null{k}" for k in range(15))
NAMED = " ".join(f"named{k}" for k in range(13))
DOCS = [(1, f"x {SECRET} y"), (2, f"{NAMED} {SECRET}"), (3, "clean words"), (4, "tiny other"), (5, None)]
ITEMS = [(None, SECRET), (None, "tiny"), (7, NAMED), (8, None)]


@pytest.mark.parametrize("block", [decontaminate.PASS_BYTES, 1])
def test_items(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.find_benchmark_words(docs, items, pass_bytes=block).collect()}
    assert got == {1: (15, [None], True), 2: (28, ["7", None], True), 3: (0, [], False), 4: (1, [None], True), 5: (0, [], False)}


def test_same_rows_as_sql(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    cursor = con.execute(queries.ORACLES["op6_decontaminate"])
    columns = [c[0] for c in cursor.description]
    got = queries.op6_decontaminate(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())
