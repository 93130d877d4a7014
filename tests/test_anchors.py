"""Alignment by anchors against longest-block-first matching of whole texts, and the report against one pass."""

import random
import statistics
from difflib import SequenceMatcher

import pytest

from tidemark.functions.text import character_map
from tidemark.operators import anchors as an
from tidemark.operators import patches as pt

LINES = "media_id long, pos int, start double, end double, text string, chunk int"


def readings(rng, n, letters="abcdefghij"):
    """Lines, and the same with replaced, lost and added words and other times."""
    left, right, t = [], [], 0.0
    for pos in range(n):
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(0, 12))]
        other = [w if rng.random() < 0.9 else "".join(rng.choice(letters) for _ in range(rng.randrange(0, 8))) for w in words]
        e = t + 0.3 * len(words) + 0.1
        left.append((pos, t, e, " ".join(words), 0))
        right.append((pos, t + rng.uniform(-0.5, 0.8), e + 0.5, ", ".join(other).upper(), 1 + pos // 15))
        t = e + rng.choice([0.0, 0.4])
    return left, right


def kept(rows):
    chars, times, chunks = [], [], []
    for _, s, e, text, chunk in rows:
        own = character_map(text)[0]
        chars += own
        chunks += [chunk] * len(own)
        times += [s + (max(s, e) - s) * (i + 0.5) / len(own) for i in range(len(own))]
    return "".join(chars), times, chunks


@pytest.fixture(scope="module")
def media():
    rng = random.Random(9)
    return {m: readings(rng, 50) for m in range(4)}


def frames(spark, media):
    make = lambda side: spark.createDataFrame([(m, *r) for m, both in media.items() for r in both[side]], LINES)
    return make(0), make(1)


@pytest.mark.parametrize("block", [16, 256])
def test_blocks(spark, media, monkeypatch, block):
    monkeypatch.setattr(pt, "BLOCK", block)
    got = an.aligned_blocks(*map(an.held, frames(spark, media))).collect()
    for m, (left, right) in media.items():
        a, b = kept(left)[0], kept(right)[0]
        own = sorted((r["a"], r["b"], r["size"]) for r in got if r["media_id"] == m)
        assert all(a[x : x + n] == b[y : y + n] for x, y, n in own)
        assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] and (p[0] + p[2], p[1] + p[2]) != q[:2] for p, q in zip(own, own[1:]))
        best = sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert sum(n for _, _, n in own) >= best - 0.01 * len(a)


def test_equal_texts_and_texts_without_a_common_gram(spark):
    text = "the same text of some length with itself"
    rows = [(1, 0, 0.0, 1.0, text, 1), (2, 0, 0.0, 1.0, "abc", 1), (3, 0, 0.0, 1.0, text, 1), (4, 0, 0.0, 1.0, "，", 1), (5, 0, 0.0, 1.0, "ab" * 40, 1)]
    other = [(1, 0, 0.0, 1.0, text, 1), (2, 0, 0.0, 1.0, "xbc", 1), (4, 0, 0.0, 1.0, "x", 1), (5, 0, 0.0, 1.0, "ab" * 40, 1)]
    left, right = spark.createDataFrame(rows, LINES), spark.createDataFrame(other, LINES)
    l, r = an.held(left), an.held(right)
    found = an.aligned_blocks(l, r)
    n = len(text.replace(" ", ""))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 0, n), (2, 1, 1, 2), (5, 0, 0, 80)]
    stats = {r["media_id"]: tuple(r)[1:] for r in an.text_stats(left.unionByName(right), l, r, found).collect()}
    assert stats[1] == (n, n, n, 1.0, 1.0, 1.0, 1.0) and stats[3] == (n, 0, 0, 0.0, 0.0, 0.0, 0.0) and stats[2][2] == 2 and stats[4] == (0, 1, 0, 0.0, 0.0, 0.0, 1.0)
    assert an.aligned_blocks(an.held(left.where("false")), r).collect() == []


def test_chain_is_longest():
    import pyarrow as pa

    rng = random.Random(2)
    for _ in range(60):
        pairs = sorted((rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(1, 14)))
        pairs = list({a: (a, b) for a, b in pairs}.values())
        batch = pa.RecordBatch.from_arrays([pa.array([7] * len(pairs), pa.int64()), *(pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))], names=["media_id", "a", "b"])
        (made,) = an._chained([batch])
        chain = list(zip(made.column(1).to_pylist(), made.column(2).to_pylist()))
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:]))
        best = [1] * len(pairs)
        for i, (_, b) in enumerate(pairs):
            best[i] = 1 + max((best[j] for j in range(i) if pairs[j][1] < b), default=0)
        assert len(chain) == max(best)


def test_timed_report(spark, media):
    left, right = frames(spark, media)
    durations = {m: both[0][-1][2] + 1 for m, both in media.items()} | {9: 50.0}
    told = an.timed_report(left, right, spark.createDataFrame(list(durations.items()), "media_id long, duration double"), chunk=20.0)
    report, chunks, spans = ({tuple(r)[: 1 + (k > 0)]: r for r in df.collect()} for k, df in enumerate(told))
    found = an.aligned_blocks(an.held(left), an.held(right)).collect()
    for m, (l, r) in media.items():
        _, lt, _ = kept(l)
        _, rt, rc = kept(r)
        pairs = [(x["a"] + i, x["b"] + i) for x in found if x["media_id"] == m for i in range(x["size"])]
        errors = sorted(abs(rt[b] - lt[a]) for a, b in pairs)
        row = report[m,]
        assert row["matched"] == len(pairs)
        assert (row["median_error"], row["p90_error"], row["max_error"]) == pytest.approx((statistics.median(errors), errors[max(0, int(len(errors) * 0.9) - 1)], errors[-1]), abs=6e-4)
        for c in set(rc):
            own = [(a, b) for a, b in pairs if rc[b] == c]
            row = chunks[m, c]
            assert (row["characters"], row["matched"]) == (rc.count(c), len(own))
            signed = [rt[b] - lt[a] for a, b in own]
            assert tuple(row)[4:] == pytest.approx((min(lt[a] for a, _ in own), max(lt[a] for a, _ in own), statistics.median(signed), statistics.median(map(abs, signed))), abs=6e-4)
        for w in range(-(-int(durations[m] * 1000) // 20000)):
            inside = {i for i, t in enumerate(lt) if 20.0 * w <= t < min(durations[m], 20.0 * (w + 1))}
            row = spans[m, w]
            assert (row["characters"], row["matched"]) == (len(inside), len(inside & {a for a, _ in pairs}))
    assert tuple(report[9,])[1:] == (0, 0.0, 0.0, 0.0) and spans[9, 2]["end"] == 50.0
