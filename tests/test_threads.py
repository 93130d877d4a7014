"""Depths of threads that are deeper and larger than a recursive query may be."""

from tidemark.operators import threads

SCHEMA = "thread_id long, node_id long, parent_id long, author string"


def test_deep_chains_cycles_and_orphans(spark):
    rows = [(1, 1, None, "a")] + [(1, i, i - 1, "a") for i in range(2, 302)]
    rows += [(2, 1, 0, "b"), (2, 2, 1, "b"), (2, 3, 1, "c"), (2, 4, 3, "d"), (2, 5, 5, "e")]  # ids of thread 1 again
    rows += [(3, 1, 3, "x"), (3, 2, 1, "x"), (3, 3, 2, "x"), (3, 4, 2, "x")]  # a cycle, and a node below it
    rows += [(4, 7, 99, "y"), (4, 8, 7, "y"), (None, 1, None, "z"), (None, 2, 1, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["thread_id"], r["node_id"]): (r["root_id"], r["depth"]) for r in threads.depths(df).collect()}
    want = {(1, i): (1, i - 1) for i in range(1, 302)}
    want |= {(2, 1): (1, 0), (2, 2): (1, 1), (2, 3): (1, 1), (2, 4): (1, 2), (2, 5): (5, 0), (None, 1): (1, 0)}
    assert got == want


def test_more_rows_than_a_recursive_query_may_have(spark):
    old = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        df = spark.createDataFrame([(i // 4, i + 1, None if i % 4 == 0 else i, "a") for i in range(2000)], SCHEMA)
        got = {r["node_id"]: (r["root_id"], r["depth"]) for r in threads.depths(df).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", old)
    assert got == {i + 1: (i - i % 4 + 1, i % 4) for i in range(2000)}


def test_no_nodes(spark):
    assert threads.depths(spark.createDataFrame([], SCHEMA)).count() == 0
