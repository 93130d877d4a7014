"""Cue breaks against a plain reading of the rules, least cost against all sets of breaks, streams cut in small lots."""

import itertools
import random
import unicodedata

import numpy as np
import pytest

from tidemark.functions.text import character_map
from tidemark.operators import cues as cu

LINES = "media_id long, pos int, start double, end double, text string"
ALPHABET = list("的一是沙丘土了人提出故事问题abAI7") + ["，", "。", "《", "》", "、", " ", "\n", "；", "：", "x", "国", "家"]


def text_of(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def kept(text):
    return [i for i, c in enumerate(text) if any(x.isalnum() for x in unicodedata.normalize("NFKC", c).lower())]


class Plain:
    """One text by the rules, a break at a time."""

    def __init__(self, text, times, limits, words=None):
        self.text, self.at, self.t, self.l, self.words = text, kept(text), times, limits, words
        self.n = len(self.at)

    def seen(self, b):
        stop = self.at[b] if b < self.n else len(self.text)
        return self.text[self.at[b - 1] : stop]

    def has(self, b, marks):
        return any(c in marks for c in self.seen(b))

    def units(self):
        ends = [b for b in range(1, self.n + 1) if self.has(b, cu.STRONG) or "\n" in self.seen(b) or b == self.n]
        return list(zip([0, *ends[:-1]], ends))

    def cost(self, s, e, stop):
        n, l = e - s, self.l
        sec = max(0.001, self.t[e - 1] - self.t[s])
        c, d = self.text[self.at[e - 1]], self.text[self.at[e]] if e < self.n else ""
        low, high = min(stop, s + l.least), min(stop, s + l.most)
        best = min(l.aim, 2.8)
        pause = cu.STRONG + cu.WEAK
        out = abs(n - min(l.most, 18)) * 0.08 + abs(sec - best) * 1.4 + max(0, e - high) * 0.9
        if self.has(e, cu.STRONG):
            out += -14 + (32 if e == stop and sec > best and stop - s >= 18 and any(self.has(b, cu.WEAK) for b in range(low, stop)) else 0)
        elif self.has(e, cu.WEAK):
            out += -10 + (n * 0.4 if any(self.has(b, pause) for b in range(e + l.least, stop + 1)) else 0)
        elif e == stop:
            out -= 5
        elif any(self.has(b, pause) for b in range(low, high + 1)):
            out += 6
        out += 2.5 * (c in cu.NO_END or d in cu.NO_START) + 20 * (c + d in cu.TOGETHER) + 4 * (self.words is not None and e not in self.words)
        out += 30 * (c.isascii() and c.isalnum() and d.isascii() and d.isalnum()) + 5 * (d in cu.CLOSERS)
        out += max(0, sec - l.seconds) * 8 + (max(0, l.least - (stop - e)) * 6 if e < stop else 0) + max(0, n / sec - 7.5) * 0.8
        return out

    def choices(self, s, stop):
        return range(min(stop, s + self.l.least), min(stop, s + self.l.most + 4) + 1)

    def cut(self):
        out = []
        for first, stop in self.units():
            s = first
            while s < stop:
                rest, sec = stop - s, self.t[stop - 1] - self.t[s]
                inner = any(self.has(b, cu.INNER) for b in range(s + self.l.least, stop))
                if rest <= self.l.most and sec <= self.l.seconds and (rest < 18 or sec <= min(self.l.aim, 2.8) or not inner):
                    e = stop
                else:
                    e = min((round(self.cost(s, e, stop), 9), e) for e in self.choices(s, stop))[1]
                out.append((s, e))
                s = e
        return out


def line(text, times, following=""):
    return (text, np.array(times), character_map(text)[1], following)


def walked(b, jump):
    out, s = [], 0
    while s < b.n:
        out.append((s, int(jump[s])))
        s = int(jump[s])
    return out


@pytest.mark.parametrize("limits", [cu.Limits(), cu.Limits(3, 9, 2.0, 1.5), cu.Limits(8, 22, 2.8)])
@pytest.mark.parametrize("with_words", [False, True])
def test_next_breaks_by_the_rules(limits, with_words):
    rng = random.Random(limits.most)
    for _ in range(120):
        text = text_of(rng, rng.randrange(1, 150))
        if not kept(text):
            continue
        times = sorted(rng.uniform(0, len(text) * rng.choice([0.08, 0.2, 0.5])) for _ in kept(text))
        words = set(rng.sample(range(1, len(times) + 1), len(times) // 2)) if with_words else None
        b = cu.Breaks([line(text, times)], (lambda chars: words) if with_words else None)
        plain = Plain(text, times, limits, words)
        assert [(s, int(b.stop[s])) for s in b.first] == plain.units()
        assert walked(b, cu.next_breaks(b, limits)) == plain.cut()


def test_least_cost_is_least_over_all_sets_of_breaks():
    rng = random.Random(4)
    limits = cu.Limits(2, 6, 1.2, 0.9)
    for _ in range(150):
        text = text_of(rng, rng.randrange(1, 22))
        if not kept(text):
            continue
        times = sorted(rng.uniform(0, len(text) * 0.15) for _ in kept(text))
        b, plain = cu.Breaks([line(text, times)]), Plain(text, times, limits)
        got = walked(b, cu.least_breaks(b, limits))
        for first, stop in plain.units():
            inside = range(first + 1, stop)
            ways = []
            for k in range(len(inside) + 1):
                for cut in itertools.combinations(inside, k):
                    cues = list(zip([first, *cut], [*cut, stop]))
                    if all(e in plain.choices(s, stop) for s, e in cues):
                        ways.append((sum(plain.cost(s, e, stop) for s, e in cues), cues))
            own = [(s, e) for s, e in got if first <= s < stop]
            assert sum(plain.cost(s, e, stop) for s, e in own) == pytest.approx(min(ways)[0])


def test_published_examples(spark):
    """Texts with known good and bad breaks."""
    cases = [
        ("大家好，我是青蛙刀圣，我们又见面了。\n今天我们会开启一个新的IP系列《沙丘》。", 0.2, cu.Limits(8, 28, 5.5)),
        ("大家最近刷国际新闻里面刷到欧美的移民话题，其中比较捕捉人眼球的是穆斯林群体。", 0.13, cu.Limits(10, 36, 6.5)),
        ("故事的舞台是在未来的一个沙漠星球，当地的土著人弗雷曼人长期受到外来殖民者的压迫。", 0.16, cu.Limits(10, 36, 4.0)),
        ("这导致人类社会已经高度依赖于AI工具和OpenAI模型。", 0.2, cu.Limits(8, 22, 2.8)),
    ]
    found = []
    for text, step, limits in cases:
        b = cu.Breaks([line(text, [i * step for i in range(len(kept(text)))])])
        found.append([cu.span(text, kept(text), s, e) for s, e in walked(b, cu.next_breaks(b, limits))])
    assert "大家好，我是青蛙刀圣，我们又见面了。" in found[0] and "今天我们会开启一个新的IP系列《沙丘》。" in found[0]
    assert not any(t.endswith("其中") for t in found[1]) and not any(t.startswith("比较") for t in found[1])
    assert not any(t.endswith("土") for t in found[2]) and not any(t.startswith("著人") for t in found[2])
    assert not any(t.endswith("Open") for t in found[3])


def test_proposed_breaks_and_reasons():
    text = "你的父亲将会失去沙丘，那是必然的，我们阻止不了事情的发生。"
    b = cu.Breaks([line(text, [i * 0.18 for i in range(len(kept(text)))])])
    got = dict(cu.checked(b, [15, 15, 0, 2, 99], 0, b.n, cu.Limits(8, 18, 6.5)))
    assert got[15] is None and got[0] == "outside" and got[99] == "outside" and got[2] == "short"
    text = "在某些城镇，随着该群体移民数量的增加，有的人就视为提出要推行穆斯林律法，增加议会席位。"
    b = cu.Breaks([line(text, [i * 0.14 for i in range(len(kept(text)))])])
    assert cu.checked(b, [28], 0, b.n, cu.Limits(10, 30, 6.5))[0][1] == "late"
    assert cu.checked(b, [17], 0, b.n, cu.Limits(10, 30, 6.5)) == [(17, "dangling")]
    b = cu.Breaks([line("abcdefg，hijklmnop，qr", [i * 0.3 for i in range(18)])])
    assert cu.checked(b, [7, 16], 0, b.n, cu.Limits(3, 40, 9.0, 9.0)) == [(7, None), (16, "short_rest")]
    assert cu.checked(b, [7, 12], 0, b.n, cu.Limits(3, 40, 9.0, 9.0)) == [(7, None), (12, "few_characters")]


def test_lines_of_a_media(spark):
    rows = [(1, 0, 0.0, 4.0, "第一句话很长很长很长，还有后面。再来"), (1, 1, 4.0, 4.01, "短"), (1, 2, 4.02, 4.05, "短。"), (1, 3, 4.0, 8.0, None), (1, 4, 4.0, 8.0, "。，"), (1, 5, None, 8.0, "x"), (1, 6, 3.0, 3.5, "回去了"), (2, 0, 0.0, 0.0, "《零》"), (None, 0, 1.0, 2.0, "无名")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], LINES + ", cue string")
    for way in ("next", "least"):
        got = cu.cue_breaks(df, way=way).orderBy("media_id", "cue").collect()
        by = {m: [r for r in got if r["media_id"] == m] for m in (1, 2, None)}
        assert [r["text"] for r in by[1]] == ["第一句话很长很长很长，还有后面。", "再来", "短", "短。", "回去了"]
        assert all(a["end"] <= b["start"] and b["end"] - b["start"] >= 0.1 - 1e-9 for a, b in zip(by[1], by[1][1:]))
        assert [r["text"] for r in by[2]] == ["《零》"] and len(by[None]) == 1
    assert cu.cue_breaks(df.where("false")).collect() == [] and cu.unit_rows(df.where("false")).collect() == []
    assert [r["text"] for r in cu.unit_rows(df.where("media_id = 1")).orderBy("pos", "unit").collect()] == ["第一句话很长很长很长，还有后面。", "再来", "短", "短。", "回去了"]


@pytest.mark.parametrize("make", ["reading", "template"])
def test_streams_in_small_lots(spark, monkeypatch, make):
    rng = random.Random(7)
    rows, t = [], 0.0
    for pos in range(60):
        n = rng.randrange(0, 40)
        rows.append((pos % 2, pos, t, t + n * 0.15, text_of(rng, n)))
        t += n * 0.15 + rng.choice([-1.0, 0.0, 0.4])
    df = spark.createDataFrame(rows, LINES)
    run = {"reading": cu.reading_cues, "template": cu.template_cues}[make]
    whole = sorted(map(tuple, run(df).collect()))
    for walk in (cu.ReadingWalk, cu.TemplateWalk):
        monkeypatch.setattr(walk, "lot", 1)
    assert sorted(map(tuple, run(df).collect())) == whole
    for media in (0, 1):
        text = "".join(r[4] for r in rows if r[0] == media)
        own = [r for r in whole if r[0] == media]
        assert [r[1] for r in own][1:] == [r[2] for r in own][:-1]
        if make == "reading":
            assert "".join(r[5] for r in own) == text
        else:
            assert own[-1][2] == len(kept(text)) and all(r[2] - r[1] <= 32 for r in own)


def test_proposed_breaks_of_lines(spark):
    """Breaks that pass the checks are taken first, what is left is cut by cost, and every proposal has its verdict."""
    rng = random.Random(11)
    rows = []
    for pos in range(40):
        text = text_of(rng, rng.randrange(20, 120))
        n = len(kept(text))
        rows.append((1, pos, 10.0 * pos, 10.0 * pos + 0.2 * max(1, n), text, [rng.randrange(-2, n + 3) for _ in range(rng.randrange(0, 9))] + [None]))
    limits = cu.Limits(4, 14, 4.0)
    got = cu.cue_breaks(spark.createDataFrame(rows, LINES + ", proposed array<int>"), limits).collect()
    seen = 0
    for m, pos, start, end, text, proposed in rows:
        at = kept(text)
        times = [start + (end - start) * (i + 0.5) / len(at) for i in range(len(at))]
        follow = next((t for p, t in ((r[1], r[4]) for r in rows) if p > pos and kept(t)), "")
        follow = follow[: kept(follow)[0] + 1] if follow else ""
        b = cu.Breaks([line(text, times, follow)])
        own = sorted((r for r in got if r["pos"] == pos), key=lambda r: r["from_char"])
        assert [r["from_char"] for r in own][1:] == [r["to_char"] for r in own][:-1] and own[-1]["to_char"] == len(at)
        for first in b.first.tolist():
            stop = int(b.stop[first])
            inside = [p for p in proposed if p is not None and first < p < stop]
            want = cu.checked(b, inside, first, stop, limits) if stop - first > limits.most else []
            unit = [r for r in own if first <= r["from_char"] < stop]
            assert [(c["at"], c["reason"]) for c in unit[0]["checks"]] == want
            good = {p for p, reason in want if reason is None}
            assert good <= {r["to_char"] for r in unit}
            seen += len(good)
    assert seen > 2
