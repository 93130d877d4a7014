"""The pipeline's stages on the smallest tables, each against its own input."""

import os

import pytest

import corpus_pipeline as cp
from tidemark.llm import decontaminate, minhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "minhash", "decontamination", "byte_bpe"]
    columns = list(cp.COLUMNS)
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = cp.written(stage(spark, before, SF), f"test-{name}")
        assert docs.columns == columns
        old, new = ({r["doc_id"]: r for r in d.collect()} for d in (before, docs))
        assert new.keys() <= old.keys()
        if name == "line_dedup":
            assert new.keys() == old.keys()
            assert all(new[i]["text"] == old[i]["text"] or len(new[i]["text"]) < len(old[i]["text"]) == old[i]["n_chars"] for i in new)
        else:
            assert all(new[i] == old[i] for i in new)
        if name == "minhash":
            groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(before).collect()}
            assert sorted(new) == sorted(set(groups.values()))
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.find_benchmark_words(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r["contaminated"]}
            assert new.keys() == old.keys() - bad
    last = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"]: r["text"] for r in last} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["n_tokens"] == len(r["ids"]) for r in last)
