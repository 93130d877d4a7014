"""What makes the cost of large tables grow with them only: plans without exchanges, matching without products, small slices."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa

from tidemark.functions import slices
from tidemark.functions import text as tx
from tidemark.operators import align as al
from tidemark.operators import context as cx
from tidemark.operators import retrieval as rt
from tidemark.plans import patched


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_and_units_shuffle_no_text(spark):
    df = spark.createDataFrame([(i, "one two。two three！ " * (i % 30)) for i in range(300)], "doc_id int, text string")
    lists = cx.sentence_lists(df)
    for made in (cx.span_units(lists), cx.span_scores(lists)):
        assert "Exchange" not in plan(made)
    want = {(r["doc_id"], r["unit"]): (r["first"], r["last"], r["text"]) for r in cx.units(cx.sentences(df)).collect()}
    assert {(r["doc_id"], r["unit"]): (r["first"], r["last"], r["text"]) for r in cx.span_units(lists).collect()} == want
    scores = {(r["doc_id"], r["unit"]): r["tfidf"] for r in cx.scored(cx.units(cx.sentences(df))).collect()}
    assert {(r["doc_id"], r["unit"]): r["tfidf"] for r in cx.span_scores(lists).collect()} == scores


def test_only_numbers_are_ranked(spark):
    df = spark.createDataFrame([(1, "one two。two three！")], "doc_id int, text string")
    windows = [line for line in plan(cx.contexts(df)).split("\n") if "Window [" in line or "Sort [" in line]
    assert windows and not any("text" in line or " s#" in line for line in windows)


def test_slices_are_small():
    sizes = [len(p) for p in slices.parts([pd.Series(range(200)), pd.Series(range(3))])]
    assert sum(sizes) == 203 and max(sizes) <= slices.ROWS


def test_windows_are_weighed_where_their_text_stands(spark):
    df = spark.createDataFrame([(i, "one two. two three! four " * (i % 30)) for i in range(300)] + [(300, None), (301, "!")], "doc_id int, text string")
    lists = rt.sentence_lists(df)
    keywords = rt.top_keywords(lists, 8, 2)
    for made in (rt.centrality(lists, 8, 2), rt.centrality(lists, 8, 2, unit_length=True), keywords):
        assert "Exchange" not in plan(made)
        spans = {(r["doc_id"], r["window"]) for r in rt.windows(rt.sentences(df), 8, 2).collect()}
        assert {(r["doc_id"], r["window"]) for r in made.collect()} == spans - {(301, 0)}
    assert keywords.where("doc_id = 1").first()["keywords"] == ["two", "three", "one", "four"]


def test_blocks_are_those_of_difflib_for_every_way(monkeypatch):
    rng = random.Random(5)
    for pairs in (1 << 18, 12, 0):  # laid out, mixed, by sorted suffixes only
        monkeypatch.setattr(al, "PAIRS", pairs)
        for _ in range(200):
            letters = "ab cé測試😀"[: rng.choice([1, 2, 3, 8])]
            a = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
            b = "".join(c if rng.random() < 0.8 else rng.choice(letters) for c in a) + rng.choice(["", "ab"])
            for x, y in ((a, b), (b, a), (a.split(), b.split())):
                assert al.blocks(x, y) == SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()


def test_long_texts_are_not_matched_by_difflib(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("every pair of items is looked at")

    monkeypatch.setattr(al, "SequenceMatcher", refuse)
    said = " ".join(f"word{k * k % 997}" for k in range(5000))
    words = [{"start": float(k), "end": k + 1.0, "text": w} for k, w in enumerate(said.split())]
    lines = [" ".join(said.split()[k : k + 20]).replace("3", "4") for k in range(0, 5000, 20)]
    assert al.placed_lines(lines, words)[0] > 0.72


def test_edits_of_turns_take_three_steps_in_python_and_no_lists_of_characters(spark, tmp_path):
    rng = random.Random(7)
    turns = [(m, k, "".join(rng.choice("eEaA -éﬁx") for _ in range(rng.randrange(60)))) for m in (1, 2, None) for k in range(20)]
    turns += [(3, 0, "e a," * 5000), (3, 1, None), (3, 2, "，"), (3, 3, "Ea")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    made = patched.applied_edits(spark, str(tmp_path))
    assert plan(made).count("ArrowEvalPython") == 3 and "chars" not in plan(made)
    got = sorted(((r["media_id"] or 0, r["pos"]), r["text"], r["n_applied"]) for r in made.collect())
    assert got == sorted(((m or 0, k), *re.subn("[eE][^0-9a-zA-Zéﬁ]*[aA]", "oy", t)) for m, k, t in turns if t and re.search("[a-zA-Zéﬁ]", t))


def test_character_maps_equal_those_of_each_form():
    for text in ("", "Ab_1 -", "ﬁ㎡İ½ é Ａ中_、", "".join(chr(c) for c in range(0x20, 0x3000))):
        forms = [unicodedata.normalize("NFKC", c).lower() for c in text]
        want = [(c, i) for i, form in enumerate(forms) for c in tx.KEPT.findall(form)]
        chars, places = tx.character_map(text)
        assert list(zip(chars, places)) == want and len(chars) == len(places) and tx.kept_text(text) == "".join(chars)


def test_arrow_slices_are_small():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 100_000] * 50 + ["y"] * 500})
    sizes = [(p.num_rows, sum(map(len, p.column(0).to_pylist()))) for p in slices.record_parts([batch, batch.slice(0, 0)])]
    assert sum(n for n, _ in sizes) == 550 and max(n for n, _ in sizes) <= slices.ROWS


def test_line_stage_goes_through_the_named_method(spark, monkeypatch):
    import corpus_pipeline

    asked, own = [], corpus_pipeline.line_dedup.remove_repeated_lines
    monkeypatch.setattr(corpus_pipeline.line_dedup, "remove_repeated_lines", lambda df, **k: asked.append(k.get("pairs", False)) or own(df, **k))
    rows = [(i, f"own {i}\nalpha beta\ngamma delta\nlast {i}", "en", "s", 9) for i in range(9)] + [(9, None, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert asked == [False, True]
    assert got == {0: (rows[0][1], 9), 9: (None, 9)} | {i: (f"own {i}\nlast {i}", 12) for i in range(1, 9)}
