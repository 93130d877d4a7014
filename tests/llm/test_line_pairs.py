"""Line dedup by pairs against brute force: short repeated passages inside different texts."""

import random

from tidemark.llm import line_dedup

SCHEMA = "doc_id long, text string, lines string"


def brute_pairs(rows):
    def pieces(lines):
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        return [(a, b, tuple(lines[a : b + 1])) for a, b in zip(full, full[1:])]

    low = {}
    for i, t in rows:
        if i is not None and t is not None:
            for *_, c in pieces(t.split("\n")):
                low[c] = min(low.get(c, i), i)
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        lines, gone, seen = t.split("\n"), set(), set()
        for a, b, c in pieces(lines):
            if low[c] < i or c in seen:
                gone.update(range(a, b + 1))
            seen.add(c)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=repr)


def test_pairs(spark):
    rng = random.Random(5)
    lines = ["", " ", *(f"line {k}" for k in range(40))]
    shared = ["first shared", "second shared", "", "third shared"]
    rows = [(i, "\n".join([rng.choice(lines) for _ in range(rng.randrange(6))] + (shared if rng.random() < 0.5 else []) + [rng.choice(lines) for _ in range(rng.randrange(4))])) for i in range(60)]
    rows += [(60, rows[0][1]), (61, None), (62, ""), (63, " \n\n"), (64, "one"), (None, rows[0][1]), (5, rows[5][1]), (7, rows[9][1]), (65, "\n".join(shared + ["x"] + shared)), (66, "a\na\na")]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame([(i, t, "z") for i, t in rows], SCHEMA), pairs=True).collect()
    assert sorted(((r["doc_id"], r["kept"]) for r in got), key=repr) == brute_pairs(rows)
    for r in got:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"])


def test_pipeline_stage_drops_a_short_passage(spark):
    import corpus_pipeline

    passage = "alpha beta gamma\ndelta epsilon zeta"
    rows = [(i, f"own {i}\n{passage}\nlast {i}", "en", "s", 0) for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"own {i}\nlast {i}" for i in range(1, 40))
