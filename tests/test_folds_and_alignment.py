"""Ordered folds, alignment, parsers and text functions on small cases worked out by hand."""

import random

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import align as al
from tidemark.operators import audit as au
from tidemark.operators import folds as fo
from tidemark.operators import intervals as iv
from tidemark.sources import reports, sinks, subtitles


def seg(start, end, text, pos=0):
    return {"media_id": 1, "pos": pos, "start": start, "end": end, "text": text}


def timeline(rows, least=0.4):
    """The rule as SQL readers know it, row by row."""
    rows = sorted(rows, key=lambda r: (r["start"], r["end"], r["pos"]))
    out, reach = [], 0.0
    for i, r in enumerate(rows):
        first = max(0.0, r["start"])
        last = max(r["end"], first + least)
        if i + 1 < len(rows):
            last = min(last, max(first, rows[i + 1]["start"]))
        if r["text"].strip():
            first = max(first, reach)
            reach = last if last > first else first + 0.001
            out.append((first, reach, r["text"].strip()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(r["media_id"], r["pos"], float(r["start"]), float(r["end"]), r["text"]) for r in rows], "media_id long, pos long, start double, end double, text string")


def test_timeline_is_monotone_and_keeps_texts(spark):
    rng = random.Random(3)
    media = {m: [seg(s := round(rng.uniform(0, 9), 1), s + round(rng.uniform(-0.2, 4), 2), rng.choice(["a", " b ", " "]), i) | {"media_id": m} for i in range(rng.randrange(8))] for m in range(150)}
    got = {}
    for r in fo.normalized_timeline(frame(spark, [r for rows in media.values() for r in rows])).collect():
        got.setdefault(r["media_id"], []).append((r["start"], r["end"], r["text"]))
    for m, rows in media.items():
        out = sorted(got.get(m, []))
        assert out == timeline(rows)
        assert all(b > a for a, b, _ in out) and all(y[0] >= x[1] - 1e-9 for x, y in zip(out, out[1:]))


def test_cues_break_at_pauses_and_marks():
    words = [seg(0, 0.3, "第一句。"), seg(1.4, 1.8, "第二句。")]
    assert [c["text"] for c in fo.folded(fo.Cues(), words)] == ["第一句。", "第二句。"]
    words = [seg(i * 0.4, i * 0.4 + 0.3, f"word{i}") for i in range(30)]
    cues = fo.folded(fo.Cues(), words)
    assert " ".join(c["text"] for c in cues) == " ".join(w["text"] for w in words)
    assert all(fo.compact_length(c["text"]) <= 42 and c["end"] - c["start"] <= 5.01 for c in cues)
    assert fo.join_words(["Hello", ",", "world", "", " again "]) == "Hello, world again" and fo.join_words(["中", "文", "ab"]) == "中文ab"


def test_chains_merge_with_the_changed_row():
    rows = [seg(0, 1, "x"), seg(1, 2, "x"), seg(2, 3, "x")]
    assert [(r["start"], r["end"]) for r in fo.folded(fo.NearDuplicates(), rows)] == [(0, 2), (2, 3)]
    short = [seg(0, 1, "a,"), seg(1, 2, "b"), seg(2, 3, "[music]"), seg(3, 4, "c")]
    assert [r["text"] for r in fo.folded(fo.ShortRows(), short)] == ["a,b", "[music]", "c"]
    chunks = [dict(seg(44, 45, "A"), chunk=0), dict(seg(45, 46, "A"), chunk=45), dict(seg(46, 47, "B"), chunk=45)]
    assert [(r["start"], r["end"], r["text"]) for r in fo.folded(fo.ChunkSeams(), chunks)] == [(44, 46, "A"), (46, 47, "B")]


def test_batches_begin_at_the_first_row():
    rows = [seg(100 + 8 * i, 108 + 8 * i, "x") for i in range(9)]
    assert [r["batch"] for r in fo.folded(fo.Batches(), rows)] == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    assert [r["start"] for r in fo.folded(fo.SpacedChapters(), [seg(s, s, "") for s in (0, 0.5, 1, 1.2, 3)])] == [0, 1, 3]


def test_spread_text_fills_the_span():
    parts = fo.timed_parts("Hello there. [music] How are you today?", 30.0)
    assert parts[0]["start"] == 0.0 and parts[-1]["end"] == 30.0
    assert "".join(p["text"] for p in parts).replace(" ", "") == "Hellothere.[music]Howareyoutoday?"
    assert fo.timed_parts("  ", 3.0) == []


def test_transferred_times_interpolate():
    times, n = al.transferred_times(list("abxd"), list("abd"), [0.0, 1.0, 3.0])
    assert n == 3 and times == [0.0, 1.0, 2.0, 3.0]
    assert al.anchored_times([0.0, 1.0, 2.0], [(0, 1.0), (2, 2.0), (1, 0.5)])[0] == 1.0


def test_fusion_takes_good_lines_only():
    words = [seg(i, i + 0.5, w) for i, w in enumerate("hello world this is a test".split())]
    base = [seg(0, 1.5, "hello world"), seg(2, 5.5, "this is a test")]
    status, rows, confidence = al.fused(["Hello, world!", "This is a test."], words, base)
    assert status == "completed" and [r["text"] for r in rows] == ["Hello, world!", "This is a test."] and confidence == 1.0
    assert al.fused(["nothing alike at all"], words, base)[0] == "blocked"
    assert al.fused([], words, base)[:2] == ("blocked", base)
    assert al.fused([], words, [])[:2] == ("blocked", [{"start": 0, "end": 5.5, "text": "hello world this is a test"}])
    said = [seg(i, i + 0.5, w) for i, w in enumerate("one line that comes twice in a row one line that comes twice in a row".split())]
    twice = [seg(0, 8.5, "one line that comes twice in a row"), seg(9, 17.5, "one line that comes twice in a row")]
    assert [(r["start"], r["end"]) for r in al.fused(["One line that comes twice in a row."] * 2, said, twice)[1]] == [(0, said[-1]["end"])]


def test_overlapping_texts_join():
    assert al.joined_texts(["the quick brown fox jumps", "brown fox jumps over it"]) == "the quick brown fox jumps over it"
    assert al.joined_texts(["one", "", "two"]) == "one\ntwo"
    rng = random.Random(5)
    distance = lambda a, b: al._prefix_errors(a, b)[-1]
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(8)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(8)))
        d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert distance(a, b) == d[-1][-1]
    for _ in range(100):  # every pair of lengths, by hand
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(2))
        b = a[rng.randrange(len(a) + 1) :] + b
        scored = [(min(m, n) - 3 * distance(a[-m:], b[:n]), n, -distance(a[-m:], b[:n])) for n in range(4, min(len(a), len(b)) + 1) for m in range(4, len(a) + 1) if max(abs(m - n), distance(a[-m:], b[:n])) <= (n >= 8) + (n >= 16)]
        assert al.overlap_length(a, b) == ((max(scored)[1], -max(scored)[2]) if scored else (0, 0))


def test_differences_rebuild_the_right_side():
    left, right = list("the cat sat"), list("the dog sat on")
    out = list(left)
    for e in reversed(al.differences(left, right)):
        out[e["left_start"] : e["left_end"]] = right[e["right_start"] : e["right_end"]]
    assert out == right
    assert [g["left_changed"] for g in al.difference_groups("a" * 50 + "x" + "b" * 50 + "y", "a" * 50 + "b" * 50)] == ["x", "y"]
    assert al.verdict("ab", "cd", "xxabxx") == "left" and al.verdict("", "cd", "ab") == "neither"


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\n<i>Hi</i>\nthere\n\n2\n00:01:00,000 --> 00:01:01,000\nBye\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:01.5 --> 00:02.250 align:start\nA &amp; <b>B</b>\n\nNOTE x\n")
    (tmp_path / "c.txt").write_text("one\n\n two \n")
    (tmp_path / "d.bin").write_text("no")
    rows = [(r["path"][-5:], r["pos"], r["start"], r["end"], r["text"]) for r in subtitles.read_subtitles(spark, str(tmp_path)).orderBy("path", "pos").collect()]
    assert rows == [("a.srt", 0, 1.0, 2.5, "Hi there"), ("a.srt", 1, 60.0, 61.0, "Bye"), ("b.vtt", 0, 1.005, 2.25, "A & B"), ("c.txt", 0, 0.0, 1.0, "one"), ("c.txt", 1, 1.0, 2.0, "two")]
    df = spark.createDataFrame([("x", "[0.5 - 1.25] <|en|>Hello  you\n[2 - 3] <|x|>")], "path string, content string")
    assert [tuple(r)[2:] for r in subtitles.bracketed(df).collect()] == [(0.5, 1.25, "Hello you")]


def test_silence_log_and_complement(spark):
    log = spark.createDataFrame([("x", "silence_start: 0\nsilence_end: 1.2\nsilence_start: 8.0", 10.0), ("y", "", 5.0)], "path string, content string, duration double")
    silent = subtitles.silence_log(log).withColumnRenamed("path", "media_id")
    durations = log.selectExpr("path as media_id", "duration")
    got = {r["media_id"]: (r["start"], r["end"]) for r in iv.complement(silent, durations).collect()}
    assert got == {"x": (1.2, 8.0), "y": (0.0, 5.0)}


def test_reports(spark):
    v2 = '{"schema_version":2,"language":"en","segments":[{"start":0,"end":1,"text":" a ","words":[{"start":"0","end":"0.5","word":"a"},{"start":"1","end":"1","word":"b"}]},{"start":1,"end":2,"text":" "}]}'
    df = reports.parsed(spark.createDataFrame([("p", v2), ("q", '[{"start":0,"end":1,"text":"x"}]'), ("r", "broken")], "path string, content string"))
    assert sorted((r["path"], r["text"]) for r in reports.segments(df).collect()) == [("p", "a"), ("q", "x")]
    assert [(r["path"], r["text"], r["source"]) for r in reports.words(df).collect()] == [("p", "a", "segments")]
    tokens = '{"sentences":[{"tokens":[{"text":" go","start":0,"end":1,"confidence":0.5},{"text":"ing","start":1,"end":2,"confidence":1.0},{"text":" on","start":2,"end":3}]}]}'
    got = reports.sub_words(spark.createDataFrame([("p", tokens)], "path string, content string")).orderBy("pos").collect()
    assert [(r["text"], r["start"], r["end"], r["probability"]) for r in got] == [("going", 0.0, 2.0, 0.75), ("on", 2.0, 3.0, None)]
    reply = 'Here:\n```json\n[{"start_seconds":5,"title":"B"},{"start_seconds":-1,"title":"A"},{"start_seconds":2,"title":" "}]\n```'
    got = reports.chapters(spark.createDataFrame([("p", reply)], "path string, content string")).collect()
    assert sorted((r["start"], r["title"]) for r in got) == [(0.0, "A"), (5.0, "B")]


def test_text_functions(spark):
    df = spark.createDataFrame([("<think>x</think>",), ("<think>x</think> y",), ("language en <asr_text> hi",), ("中文abc,",)], "t string")
    got = [tuple(r) for r in df.select(tx.without_thoughts(F.col("t")), tx.without_protocol(F.col("t")), tx.spaced_cjk(F.col("t")), tx.alignment_text(F.col("t"))).collect()]
    assert got[0][0] == "<think>x</think>" and got[1][0] == "y" and got[2][1] == "hi" and got[3][2] == "中文 abc," and got[3][3] == "中文abc"
    one = df.limit(1).select(tx.masked(F.lit("")), tx.masked(F.lit("short")), tx.masked(F.lit("a" * 30)), tx.file_title(F.lit(" a/b:c. ")), tx.vtt_seconds(F.lit("00:01.5"))).first()
    assert tuple(one) == ("not saved", "saved (5 characters)", "a" * 10 + "..." + "a" * 10, "a_b_c", 1.005)
    reply = df.limit(1).select(tx.numbered_lines(F.lit("1: a\n2: b\n1: c"), F.lit(2)), tx.numbered_lines(F.lit("x\ny"), F.lit(2)), tx.numbered_lines(F.lit("x"), F.lit(2))).first()
    assert tuple(reply) == ({0: "c", 1: "b"}, {0: "x", 1: "y"}, {})


def test_stuttering_chunks_are_bad(spark):
    rows = [(1, 0, 0.0, 25.0, "go " * 20), (2, 0, 0.0, 4.0, "plenty of words here to read"), (2, 1, 12.0, 25.0, "and then some more of them, quite a lot in fact")]
    df = spark.createDataFrame(rows, "media_id int, pos int, start double, end double, text string")
    media = spark.createDataFrame([(1, 25.0), (2, 25.0), (3, 25.0), (4, 10.0)], "media_id int, duration double")
    assert {r["media_id"]: r["bad"] for r in au.bad_chunk(df, media).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_islands_don_t_depend_on_partitions_and_settle(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), i, s := rng.uniform(0, 50), s + rng.uniform(0, 5), "r") for i in range(200)]
    df = spark.createDataFrame(rows, "media_id int, pos int, start double, end double, reason string")
    once = iv.merge_regions(df, guard=0.0)
    again = iv.merge_regions(once.withColumnRenamed("region", "pos"), guard=0.0)
    key = lambda d: sorted((r["media_id"], r["start"], r["end"]) for r in d.collect())
    assert key(once) == key(again) == key(iv.merge_regions(df.repartition(7), guard=0.0))


def test_documents_and_blocked_phrases(spark):
    df = spark.createDataFrame([(1, 1, 61.0, 62.0, "b"), (1, 0, 0.0, 1.5, "a")], "media_id int, pos int, start double, end double, text string")
    assert sinks.srt_documents(df).first()["document"] == "1\n00:00:00,000 --> 00:00:01,500\na\n\n2\n00:01:01,000 --> 00:01:02,000\nb\n"
    assert sinks.text_documents(df, stamped=True).first()["document"] == "[00:00 - 00:01] a\n[01:01 - 01:02] b"
    phrases = spark.createDataFrame([("b",), ("# a",), (" ",)], "phrase string")
    assert [r["text"] for r in sinks.without_phrases(df, phrases).collect()] == ["a"]
