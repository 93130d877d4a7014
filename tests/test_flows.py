"""Chunk flows against one pass over each media, and the gate among attempts."""

import math
import random

import pytest

from tidemark.operators import flows as fl

MEDIA = "media_id long, duration double"
ATTEMPTS = "media_id long, chunk int, attempt int, language string"
ROWS = "media_id long, chunk int, attempt int, pos int, start double, end double, text string"
VOICE = "media_id long, chunk int, voice double, length double"
BAD = "la " * 60


def merged(rows, within=1.5):
    out = []
    for s, e, t in sorted(rows):
        if out and out[-1][2] == t and abs(s - out[-1][0]) <= within and abs(e - out[-1][1]) <= within:
            out[-1] = (min(s, out[-1][0]), max(e, out[-1][1]), t)
        else:
            out.append((s, e, t))
    return out


@pytest.mark.parametrize("width", [2.0, 30.0])
def test_near_duplicates_over_seams(spark, width):
    rng = random.Random(int(width))
    rows = []
    for m in range(6):
        t = 0.0
        for _ in range(150):
            t += rng.choice([0.0, 0.1, 0.4, 0.9, 1.4, 1.6])
            rows.append((m, round(t, 3), round(t + rng.choice([0.1, 0.5, 1.0, 2.5]), 3), rng.choice("aab" if m % 2 else "aaaaaaaaab")))
    df = spark.createDataFrame([(*r, "other") for r in rows], "media_id long, start double, end double, text string, open string")
    got = fl.near_duplicates(df.drop("open"), width=width).collect()
    for m in range(6):
        assert sorted((r["start"], r["end"], r["text"]) for r in got if r["media_id"] == m) == merged([r[1:] for r in rows if r[0] == m])


def plain_windows(duration, chunk, overlap):
    out = []
    for k in range(math.ceil(duration / chunk)):
        start = max(0.0, k * chunk - (overlap if k else 0.0))
        lead = k * chunk - start
        length = min(chunk + lead + overlap, duration - start)
        out.append((k, start, length, lead, overlap if start + length < duration else 0.0))
    return out


def test_windows(spark):
    media = [(1, 61.0), (2, 30.0), (3, 31.9), (4, 0.0), (5, None), (6, 95.5)]
    got = fl.overlapped_windows(spark.createDataFrame(media, MEDIA)).collect()
    for m, duration in media:
        assert sorted(tuple(r)[1:] for r in got if r["media_id"] == m) == (plain_windows(duration, 30.0, 2.0) if duration else [])
    assert sorted(tuple(r) for r in fl.fixed_windows(spark.createDataFrame(media, MEDIA)).collect())[:4] == [(1, 0, 0.0, 60.0), (1, 1, 60.0, 1.0), (2, 0, 0.0, 30.0), (3, 0, 0.0, 31.9)]


def heard(rng, n):
    rows, t = [], rng.uniform(-1, 3)
    for pos in range(n):
        e = t + rng.choice([-0.1, 0.5, 2.0, 4.0])
        rows.append((pos, round(t, 2), round(e, 2), rng.choice(["one", "two", " two ", "", None])))
        t += rng.choice([0.0, 0.5, 2.0])
    return rows


def test_overlapped_flow(spark):
    rng = random.Random(1)
    media = [(m, rng.choice([61.0, 47.3, 130.0])) for m in range(8)]
    attempts, rows, voice, want = [], [], [], {}
    for m, duration in media:
        everything = []
        for k, start, length, lead, trail in plain_windows(duration, 30.0, 2.0):
            if rng.random() < 0.8:
                v = rng.choice([0.0, 0.0005, 1.5])
                whole = rng.random() < 0.5
                voice.append((m, k, v, length if whole else length - 2))
                offset = 0.0 if v <= 0.001 and whole else v
                attempts.append((m, k, 0, "en"))
                own = heard(rng, 12)
                rows += [(m, k, 0, *r) for r in own]
                for _, s, e, t in own:
                    a, z = max(s + offset, lead), min(e + offset, max(0.0, length - trail))
                    if t is not None and t.strip() and z > a:
                        everything.append((a + start, z + start, t.strip()))
            elif rng.random() < 0.5:
                attempts.append((m, k, 0, "en"))
                rows.append((m, k, 0, 0, 0.0, 9.0, "silent chunks aren't asked"))
        want[m] = merged(everything)
    frames = [spark.createDataFrame(x, y) for x, y in ((media, MEDIA), (attempts, ATTEMPTS), (rows, ROWS), (voice, VOICE))]
    got = fl.overlapped_flow(*frames)[0].collect()
    for m, _ in media:
        own = sorted((r["start"], r["end"], r["text"]) for r in got if r["media_id"] == m)
        assert [r[2] for r in own] == [r[2] for r in want[m]]
        assert [x for r in own for x in r[:2]] == pytest.approx([x for r in want[m] for x in r[:2]])


def test_attempts_and_fixed_chunks(spark):
    media = spark.createDataFrame([(1, 290.0), (2, 20.0)], MEDIA)
    attempts = [(1, 0, 0, "en"), (1, 1, 0, "en"), (1, 1, 1, "fr"), (1, 2, 0, "de"), (1, 2, 1, ""), (1, 3, 0, "xx"), (2, 0, 0, None)]
    rows = [(1, 0, 0, 0, 0.05, 4.0, "a"), (1, 0, 0, 1, 3.0, 70.0, "b"), (1, 0, 0, 2, 5.0, 6.0, " "), (1, 1, 0, 0, 0.0, 5.0, BAD), (1, 1, 1, 0, 0.0, 5.0, "good"), (1, 2, 0, 0, 0.0, 5.0, BAD), (1, 2, 1, 0, 0.0, 5.0, BAD), (1, 3, 0, 0, 0.0, 1.0, "silent"), (2, 0, 0, 0, -1.0, 1.0, None), (2, 0, 0, 1, 0.0, 1.0, "second row")]
    voice = [(1, 0, 2.5, 50.0), (1, 1, 0.0, 60.0), (1, 2, 0.0, 60.0), (1, 4, 0.0, 50.0), (2, 0, 2.0, 10.0)]
    words = [(1, 0, 0, 0, -0.5, 0.5, "w"), (1, 1, 0, 0, 0.0, 1.0, "not taken"), (1, 1, 1, 0, 0.0, 1.0, "v")]
    a, r, v, w = (spark.createDataFrame(x, y) for x, y in ((attempts, ATTEMPTS), (rows, ROWS), (voice, VOICE), (words, ROWS)))
    chosen = {tuple(x)[:2]: tuple(x)[2:] for x in fl.chosen_attempts(fl.fixed_windows(media), a, r, v).collect()}
    assert chosen == {(1, 0): (0, "ok", None), (1, 1): (1, "retried", "phrase in a row"), (1, 2): (None, "unstable", "phrase in a row"), (1, 3): (None, "silent", None), (1, 4): (None, "missing", None), (2, 0): (0, "ok", None)}
    out, verdicts, own = fl.fixed_flow(media, a, r, v, w)
    assert sorted(tuple(x) for x in out.collect()) == [(1, 0, 0, 2.5, 4.0, "a"), (1, 0, 1, 3.0, 60.0, "b"), (1, 1, 0, 60.0, 65.0, "good"), (2, 0, 1, 0.0, 1.0, "second row")]
    assert sorted(tuple(x) for x in verdicts.collect()) == [(1, "de", "unstable", "phrase in a row"), (2, "", "ok", None)]
    assert sorted(tuple(x) for x in own.collect()) == [(1, 0, 0, 0.0, 0.5, "w"), (1, 1, 0, 60.0, 61.0, "v")]


def test_trimmed_flow(spark):
    media = spark.createDataFrame([(1, 61.0)], MEDIA)
    windows = fl.overlapped_windows(media)
    a = spark.createDataFrame([(1, 1, 0, "en")], ATTEMPTS)
    r = spark.createDataFrame([(1, 1, 0, 0, 0.0, 2.5, " a  b "), (1, 1, 0, 1, -3.0, 1.0, "gone"), (1, 1, 0, 2, 30.0, 99.0, "c")], ROWS)
    v = spark.createDataFrame([(1, 1, 1.0, 20.0)], VOICE)
    assert [tuple(x) for x in fl.trimmed_flow(windows, a, r, v)[0].orderBy("pos").collect()] == [(1, 1, 0, 30.0, 31.5, "a b"), (1, 1, 2, 59.0, 61.0, "c")]


def test_text_flow_and_empty_tables(spark):
    media = spark.createDataFrame([(1, 1300.0), (2, 5.0)], MEDIA)
    texts = spark.createDataFrame([(1, 0, "first"), (1, 1, ""), (1, 2, "third "), (1, 7, "no room"), (2, 0, None)], "media_id long, chunk int, text string")
    rows = spark.createDataFrame([(1, 2, 0, 1.0, 2.0, "x"), (1, 0, 0, 0.5, 1.0, "y")], "media_id long, chunk int, pos int, start double, end double, text string")
    out, docs = fl.text_flow(media, texts, rows)
    assert sorted(tuple(x) for x in out.collect()) == [(1, 0, 0, 0.5, 1.0, "y"), (1, 2, 0, 1201.0, 1202.0, "x")]
    assert sorted(tuple(x) for x in docs.collect()) == [(1, 3, 2, "first\nthird"), (2, 1, 0, "")]
    none = [spark.createDataFrame([], s) for s in (MEDIA, ATTEMPTS, ROWS, VOICE)]
    assert fl.overlapped_flow(*none)[0].collect() == [] and fl.fixed_flow(*none)[1].collect() == []
