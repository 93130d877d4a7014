"""Spelling variants: the tries against all pairs, hot groups, and the query against its rule in plain Python."""

import random
import re
import zlib
from collections import Counter

from tidemark.llm import queries, spelling
from tidemark.llm.errata import one_edit_pairs

from .test_operators import frame, odd_texts


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_errata_tries():
    rng = random.Random(3)
    for _ in range(1500):
        texts = list({"".join(rng.choice("abc"[: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(40))})
        found = list(one_edit_pairs(texts))
        pairs = [(min(i, j), max(i, j)) for i, j, _, _ in found]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near(texts[i], texts[j])}
        for i, j, at, reach in found:
            a, b = texts[i], texts[j]
            assert a[:at] == b[:at] and a[at : at + 1] != b[at : at + 1]
            assert len(a) == len(b) or a == b[:at] + b[at + 1 :] and reach == (at == len(a))


def test_very_long_strings():
    long = "ab" * 200_000
    texts = [long, long + "x", "x" + long, long[:99_999] + "z" + long[99_999:], long[:7] + "q" + long[8:], "short"]
    found = {tuple(sorted(p[:2])) for p in one_edit_pairs(texts)}
    assert found == {(0, 1), (0, 2), (0, 3), (0, 4)}


def plain(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    made = {}
    for w in n:
        others = [o for o in n if o != w and near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        made[w] = [form, n[w], len(others), n[form] if form else None]
    out = []
    for w, (form, count, n_near, form_n) in made.items():
        root = w
        while made[root][0] is not None:
            root = made[root][0]
        out.append((w, form, root, count, n_near, form_n))
    return sorted(out, key=repr)


def documents(rng):
    stems = ["tidal", "tidally", "harbour", "harbor", "colour", "naïveté", "aaaaa", "aaaaaa", "ÀÉÎÕÜ", "motion", "mot÷on", "Bewegung"]
    texts = []
    for _ in range(120):
        line = []
        for _ in range(40):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "e", "x", w[at] * 2, "é"]) + w[at + rng.randrange(2) :]
            line.append(rng.choice([w, w, w.upper() if w.isascii() else w]))
        texts.append(rng.choice([" ", ", ", "1", "\n"]).join(line))
    return texts


def test_query(spark, tmp_path):
    texts = [*documents(random.Random(8)), *odd_texts(), None, "", "longword" * 2000, "longword" * 2000, "longword" * 2000, "long" + "longword" * 2000]
    rows = [*enumerate(texts), (None, texts[0]), (5, texts[1]), (5, texts[1])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows)
    assert sum(r[1] is not None for r in want) > 30 and any(r[1] not in (None, r[2]) for r in want)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_hot_groups_are_cut(spark):
    rng = random.Random(2)
    words = {"".join(["prefix", *(rng.choice("ab") for _ in range(7)), rng.choice(["", "tail"])]) for _ in range(400)}
    words |= {w[:-1] for w in list(words)[:60]} | {"prefix" + c + "b" * 6 for c in "acdefgh"} | {"b" * k for k in range(5, 14)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for most in (2048, 7):
        found = [(r["word"], r["other"]) for r in spelling.near_words(df, 5, most).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a in words for b in words if a != b and near(a, b)}


def test_empty(spark):
    assert spelling.group_variants(frame(spark, [])).collect() == []
    assert spelling.group_variants(frame(spark, [(1, None), (2, "one two")])).collect() == []
