"""Cues cut out of timed text without changing it: units at sentence ends, breaks of least cost, cues for reading.

Rows are lines of a media: (media_id, pos, start, end, text), the media's text being its lines with a line end between. A
kept character (letter or digit after NFKC) has its time at its middle within the line's span. A *break* is a number of
kept characters; what stands between them and the next one belongs to the break.

The cost of a cue depends on its own characters and on those just behind it, never on other cues, so the costs of all starts
of a batch of lines are worked out together, a cue length at a time. From them a cue either takes the cheapest next break
(``"next"``), or a unit is cut where the sum over its cues is least (``"least"``), from its end to its start.

Units end at line ends, so lines are rows of their own and a media is never gathered; what reaches over lines (the next
line's first character, the end of the cue before) are window columns. Cues for reading run on over line ends: they stream
through sorted partitions with the few characters that the next cue may still need.

Lines that are null, empty or without kept characters have no cues; a line with a null time has none either; of lines that
repeat a pos the order is by start and text. A row's other columns are left behind.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.slices import record_parts
from ..functions.text import character_map
from .align import LEADING, TRAILING

# Sentence ends, softer marks, marks that check a proposed break; marks that close; characters that don't
# begin a cue well, and that don't end one well; pairs of characters that stay together.
STRONG, WEAK, INNER, ANY = "。！？；", "，、：", "，、：；,.!?;", "，。！？、：；,.!?;:"
CLOSERS = "》）】”’"
NO_START = "，。！？、：；,.!?;:》）】”’」』的了着过和与及或在是有这那其为以被把对从到中上下内外后前里之而但就都也又还更能会要将让给"
NO_END = "其土实穆伊弗雷厄哈贝阿欧美反殖宗预救保男女公皇宇香沙主核"
TOGETHER = frozenset(
    "提出 提升 行动 行事 最终 主动 直接 间接 相信 预言 实现 民族 独立 斗争 描写 土著 弗雷 雷曼 保罗 厄崔 哈克 穆斯 斯林 伊斯 斯兰"
    " 沙丘 香料 皇帝 公爵 姐妹 宇航 工会 家族 救世 殖民 宗教 文化 社会 问题 故事 电影 小说 作者 人类 科技 复杂 计算 思考 行政 决策 高级 任务 越来越 不断".split()
)
#: Room before and after a cue's characters, and the shortest cue that follows another, in milliseconds.
ROOM_MS, SHORTEST_MS = 80, 100


@dataclass(frozen=True)
class Limits:
    """Characters and seconds of a cue; ``aim`` is the length in seconds that is best, never over 2.8."""

    least: int = 10
    most: int = 30
    seconds: float = 6.5
    aim: float = 4.2

    @property
    def best(self) -> float:
        return min(self.aim, 2.8)


ASCII_WORD = string.ascii_letters + string.digits


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _counted(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


class Breaks:
    """Kept characters of many lines, one after another, and what each break between them shows.

    ``time[k]`` of character k; ``stop[k]`` the end of its unit. Arrays by break b speak of the characters b - 1 and b.
    """

    def __init__(self, lines: list[tuple[str, np.ndarray, list[int], str]], word_ends: Callable[[list[str]], set[int]] | None = None):
        """lines: (text, time of each kept character, their places in the text, what follows the line up to the next kept character)."""
        # All lines end to end, each with its line end and what follows up to the next kept character.
        raw = [text + "\n" + following[:-1] for text, _, _, following in lines]
        codes = _codes("".join(raw))
        sizes = np.array([len(places) for _, _, places, _ in lines], dtype=np.int64)
        self.n = n = int(sizes.sum())
        self.line = np.repeat(np.arange(len(lines)), sizes)
        self.time = np.concatenate([t for _, t, _, _ in lines]) if lines else np.zeros(0)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        begin = np.concatenate([np.array(places, dtype=np.int64) + end - len(r) for (_, _, places, _), r, end in zip(lines, raw, ends)]) if lines else np.zeros(0, dtype=np.int64)
        final = np.cumsum(sizes)[sizes > 0] - 1
        stop, after = np.append(begin[1:], 0)[:n], np.append(codes[begin[1:]], 0)[:n]
        stop[final] = ends[sizes > 0]
        after[final] = [ord(following[-1]) if following else 0 for (_, _, _, following), size in zip(lines, sizes) if size]
        before = codes[begin]

        def shown(marks: str) -> np.ndarray:
            count = _counted(np.isin(codes, _codes(marks)))
            return count[stop] > count[begin]

        at_breaks = lambda flags: np.concatenate([[False], flags])
        self.strong, self.weak, self.inner, self.any = (at_breaks(shown(marks)) for marks in (STRONG, WEAK, INNER, ANY))
        word = lambda c: (c < 128) & np.isin(c, _codes(ASCII_WORD))
        self.dangling = at_breaks(np.isin(before, _codes(NO_END)) | np.isin(after, _codes(NO_START)) | (after == 0))
        self.torn = at_breaks(np.isin(before.astype(np.int64) << 21 | after, [ord(t[0]) << 21 | ord(t[1]) for t in TOGETHER if len(t) == 2]))
        self.in_word = at_breaks(word(before) & word(after))
        self.closing = at_breaks(np.isin(after, _codes(CLOSERS)) | (after == 0))
        self.bare = at_breaks(~np.isin(before, _codes(ANY)))
        self.off_word = np.zeros(n + 1, dtype=bool)
        if word_ends is not None:
            first = 0
            for text, _, places, _ in lines:
                known = word_ends([text[p] for p in places])
                self.off_word[first + 1 : first + len(places) + 1] = [b not in known for b in range(1, len(places) + 1)]
                first += len(places)
        # A unit ends where a sentence or a line does.
        last = self.strong[1:] | shown("\n")
        ends = np.flatnonzero(last) + 1
        self.stop = ends[np.searchsorted(ends, np.arange(n), side="right")] if n else np.zeros(0, dtype=np.int64)
        self.first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
        self.counts = {name: _counted(flags) for name, flags in (("weak", self.weak), ("inner", self.inner), ("any", self.any), ("pause", self.strong | self.weak))}

    def within(self, name: str, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a break from ``low`` to ``high``, both included, shows such a mark."""
        top = np.clip(high + 1, 0, self.n + 1)
        return self.counts[name][np.maximum(top, np.minimum(low, self.n + 1))] > self.counts[name][np.minimum(low, self.n + 1)]


def unit_costs(b: Breaks, limits: Limits, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(break, cost) of each start for one cue length after the other, shortest first; cost is infinite where a start has
    no such break."""
    stop, time = b.stop[start], b.time[start]
    low = np.minimum(stop, start + max(1, limits.least))
    high = np.minimum(stop, start + max(1, limits.most))
    reach = np.minimum(stop, high + 4)
    pause_near, comma_ahead = b.within("pause", low, high), b.within("weak", low, stop - 1)
    for length in range(1, max(1, limits.most) + 5):
        end = start + length
        here = (end >= low) & (end <= reach)
        if not here.any():
            continue
        e = np.minimum(end, b.n)
        last = e == stop
        seconds = np.maximum(0.001, b.time[e - 1] - time)
        left = stop - e
        cost = abs(length - min(limits.most, 18)) * 0.08 + abs(seconds - limits.best) * 1.4
        cost = cost + np.where(e > high, (e - high) * 0.9, 0.0)
        late = last & (seconds > limits.best) & comma_ahead & (stop - start >= 18)
        more = b.within("pause", e + limits.least, stop)
        plain = np.where(last, -5.0, np.where(pause_near, 6.0, 0.0))
        cost = cost + np.where(b.strong[e], -14.0, np.where(b.weak[e], -10.0, plain))
        cost = cost + np.where(b.strong[e], np.where(late, 32.0, 0.0), np.where(b.weak[e] & more, length * 0.40, 0.0))
        for flags, weight in ((b.dangling, 2.5), (b.torn, 20.0), (b.off_word, 4.0), (b.in_word, 30.0), (b.closing, 5.0)):
            cost = cost + np.where(flags[e], weight, 0.0)
        cost = cost + np.where(seconds > limits.seconds, (seconds - limits.seconds) * 8.0, 0.0)
        cost = cost + np.where((left > 0) & (left < limits.least), (limits.least - left) * 6.0, 0.0)
        rate = length / seconds
        cost = cost + np.where(rate > 7.5, (rate - 7.5) * 0.8, 0.0)
        yield e, np.where(here, cost, np.inf)


def next_breaks(b: Breaks, limits: Limits, also: list[int] | tuple[int, ...] = ()) -> np.ndarray:
    """For each start of a cue its break, for others their unit's end: the rest of the unit where that is short enough, else
    the cheapest break. All units take their first cue together, then their second one, and so on; ``also`` are further
    starts."""
    jump, start = b.stop.copy(), np.union1d(b.first, np.array(also, dtype=np.int64))
    while len(start):
        stop = b.stop[start]
        best, found = np.full(len(start), np.inf), stop.copy()
        for end, cost in unit_costs(b, limits, start):
            better = cost < best
            best, found = np.where(better, cost, best), np.where(better, end, found)
        rest, seconds = stop - start, b.time[stop - 1] - b.time[start]
        inner = b.within("inner", start + limits.least, stop - 1)
        whole = (rest <= limits.most) & (seconds <= limits.seconds) & ((rest < 18) | (seconds <= limits.best) | ~inner)
        jump[start] = found = np.where(whole, stop, found)
        start = np.unique(found[found < stop])
    return jump


def least_breaks(b: Breaks, limits: Limits) -> np.ndarray:
    """For each start the first break of the cheapest way to its unit's end; of equal ways the shorter first cue."""
    ends, costs = zip(*unit_costs(b, limits, np.arange(b.n))) if b.n else ((), ())
    ends, costs = np.array(ends), np.array(costs)
    total, found = np.zeros(b.n + 1), b.stop.copy()
    for start in range(b.n - 1, -1, -1):
        stop = b.stop[start]
        ways = costs[:, start] + np.where(ends[:, start] == stop, 0.0, total[ends[:, start]])
        k = int(ways.argmin())
        total[start], found[start] = ways[k], ends[k, start]
    return found


#: Why a proposed break isn't taken, as ``checked`` tries them in this order.
REASONS = ("outside", "short", "dangling", "brief", "late", "past_mark", "few_characters", "long", "slow", "in_word", "short_rest")


def checked(b: Breaks, proposed: list[int], start: int, end: int, limits: Limits) -> list[tuple[int, str | None]]:
    """(break, reason or None) of each distinct proposed break of a unit; a break is held against the one taken before it."""
    out, before = [], start
    for at in sorted(set(proposed)):
        if at <= before or at >= end:
            out.append((at, "outside"))
            continue
        length, seconds = at - before, max(0.001, float(b.time[at - 1] - b.time[before]))
        earlier = bool(b.within("any", np.array(before + limits.least), np.array(at - 1)))
        here = bool(b.any[at])
        tests = (
            ("short", length < limits.least),
            ("dangling", bool(b.dangling[at])),
            ("brief", seconds < 0.85),
            ("late", seconds > limits.best and earlier),
            ("past_mark", not here and earlier),
            ("few_characters", bool(b.bare[at]) and not here and length < max(18, limits.least)),
            ("long", length > limits.most + 4),
            ("slow", seconds > limits.seconds + 0.8),
            ("in_word", bool(b.off_word[at])),
        )
        reason = next((name for name, holds in tests if holds), None)
        out.append((at, reason))
        if reason is None:
            before = at
    if before > start and end - before < limits.least:
        place = max(k for k, (at, reason) in enumerate(out) if reason is None)
        out[place] = (out[place][0], "short_rest")
    return out


def span(text: str, places: list[int], start: int, end: int) -> str:
    """The text of kept characters [start, end) with the marks that belong to it."""
    a, z = places[start], places[end - 1] + 1
    head = text[:a]
    a = len(head.rstrip(LEADING))
    stop = places[end] if end < len(places) else len(text)
    gap = text[z:stop]
    return text[a : z + len(gap) - len(gap.lstrip(TRAILING))].strip()


def _with_following(df: DataFrame, key: str) -> DataFrame:
    """Lines with kept characters, in order, and the start of the next one up to its first kept character."""
    lines = df.select(key, "pos", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text", *[c for c in ("proposed",) if c in df.columns])
    lines = lines.where(F.col("text").rlike(r"[\p{L}\p{N}]") & F.col("start").isNotNull() & F.col("end").isNotNull())
    by = Window.partitionBy(key).orderBy("pos", "start", "text")
    opening = F.regexp_extract("text", r"(?s)^.*?[\p{L}\p{N}]", 0)
    return lines.withColumn("following", F.coalesce(F.lead(opening).over(by), F.lit(""))).withColumn("line", F.row_number().over(by))


def _lots(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The lines in batches of about ``most`` characters; a longer line stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch.column(batch.schema.get_field_index("text"))).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def _read(batch: pa.RecordBatch) -> tuple[list[tuple[str, np.ndarray, list[int], str]], list[int]]:
    """Lines of a batch for Breaks, and their row numbers; a line whose letters NFKC takes away is left out."""
    rows, numbers = [], []
    columns = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
    for number, (text, start, end, following) in enumerate(zip(columns["text"], columns["start"], columns["end"], columns["following"])):
        chars, places = character_map(text)
        if chars:
            rows.append((text, start + (max(start, end) - start) * (np.arange(len(chars)) + 0.5) / len(chars), places, following))
            numbers.append(number)
    return rows, numbers


def unit_rows(df: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, pos, unit, text) of each sentence of each line: strong marks and line ends end a unit."""

    def run(batches):
        for batch in _lots(batches):
            rows, numbers = _read(batch)
            b = Breaks(rows)
            line = b.line[b.first]
            begin = np.searchsorted(b.line, np.arange(len(rows)))
            texts = [span(rows[k][0], rows[k][2], s - begin[k], e - begin[k]) for k, s, e in zip(line, b.first, b.stop[b.first])]
            at = pa.array(np.array(numbers, dtype=np.int64)[line] if len(line) else [], pa.int64())
            unit = np.arange(len(line)) - np.searchsorted(line, line)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(unit.astype(np.int32)), pa.array(texts, pa.string())], names=[key, "pos", "unit", "text"])

    kind = dict(df.dtypes)
    return _with_following(df, key).mapInArrow(run, f"{key} {kind[key]}, pos {kind['pos']}, unit int, text string")


def cue_breaks(df: DataFrame, limits: Limits = Limits(), way: str = "next", word_ends: Callable[[list[str]], set[int]] | None = None, key: str = "media_id") -> DataFrame:
    """(key, pos, cue, start, end, text, from_char, to_char, checks) of every line. ``way`` is "next" or "least". A column
    ``proposed`` (array of breaks within the line) is tried first in units of over ``limits.most`` characters; ``checks`` has
    each of them with the reason if it wasn't taken, at the first cue of its unit.

    A cue starts ROOM_MS before its first character, not before the end of the cue before it, and ends ROOM_MS after its
    last; it lasts SHORTEST_MS at least.
    """
    if way not in ("next", "least"):
        raise ValueError(f"no such way: {way}")
    checks_type = pa.list_(pa.struct([("at", pa.int32()), ("reason", pa.string())]))

    def run(batches):
        for batch in _lots(batches):
            rows, numbers = _read(batch)
            b = Breaks(rows, word_ends)
            asked = batch.column(batch.schema.get_field_index("proposed")).to_pylist() if "proposed" in batch.schema.names else None
            begin = np.searchsorted(b.line, np.arange(len(rows)))
            taken: dict[int, list[tuple[int, str | None]]] = {}
            if asked is not None:
                for first, stop in zip(b.first.tolist(), b.stop[b.first].tolist() if b.n else []):
                    k = int(b.line[first])
                    own = [int(at) + int(begin[k]) for at in asked[numbers[k]] or [] if at is not None and first < at + int(begin[k]) < stop]
                    if stop - first > limits.most and own:
                        taken[first] = checked(b, own, first, stop, limits)
            jump = least_breaks(b, limits) if way == "least" else next_breaks(b, limits, sorted(at for found in taken.values() for at, reason in found if reason is None))
            out = []
            for first, stop in zip(b.first.tolist(), b.stop[b.first].tolist() if b.n else []):
                k = int(b.line[first])
                text, _, places, _ = rows[k]
                zero, found = int(begin[k]), taken.get(first, [])
                told = [{"at": at - zero, "reason": reason} for at, reason in found]
                forced = [at for at, reason in found if reason is None]
                at = first
                while at < stop:
                    end = next((f for f in forced if f > at), None) or int(jump[at])
                    out.append((numbers[k], at - zero, end - zero, max(0.0, float(b.time[at]) - ROOM_MS / 1000), float(b.time[end - 1]) + ROOM_MS / 1000, span(text, places, at - zero, end - zero), told if at == first else []))
                    at = end
            columns = list(zip(*out)) if out else [[]] * 7
            at = pa.array(columns[0], pa.int64())
            low, high = (pa.array([round(t * 1000) for t in columns[c]], pa.int64()) for c in (3, 4))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(at) for c in (key, "pos", "line")), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), low, high, pa.array(columns[5], pa.string()), pa.array(columns[6], checks_type)], names=[key, "pos", "line", "from_char", "to_char", "low", "high", "text", "checks"])

    kind = dict(df.dtypes)
    made = _with_following(df, key).mapInArrow(run, f"{key} {kind[key]}, pos {kind['pos']}, line int, from_char int, to_char int, low long, high long, text string, checks array<struct<at:int,reason:string>>")
    return _chained(made, key, ("line", "from_char")).select(key, "pos", (F.row_number().over(Window.partitionBy(key).orderBy("line", "from_char"))).alias("cue"), "start", "end", "text", "from_char", "to_char", "checks")


def _chained(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """start and end from ``low`` and ``high``, in order: a cue starts at the end of the one before it at the earliest.

    The end of cue i is the greatest of (own end of j) + SHORTEST_MS * (i - j) over the cues j up to it, a running maximum.
    """
    by = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(by).cast("long"))
    own = F.greatest("high", F.col("low") + SHORTEST_MS) - SHORTEST_MS * F.col("_i")
    rows = rows.withColumn("_end", F.max(own).over(by.rowsBetween(Window.unboundedPreceding, 0)) + SHORTEST_MS * F.col("_i"))
    begin = F.greatest("low", F.coalesce(F.lag("_end").over(by), F.lit(0)))
    return rows.withColumn("start", begin / 1000).withColumn("end", F.col("_end") / 1000).drop("_i", "_end", "low", "high")


class Walk:
    """Cues of one media as its characters come: ``steps`` says for each start where its cue ends, right for starts with
    ``ahead`` characters behind them, and for all at the media's end. A part is a character with what precedes it in its
    cue."""

    ahead = 0
    #: Parts that are gathered before the next look.
    lot = 2048
    #: The media's limit in time is passed.
    over = False

    def __init__(self):
        self.parts, self.time, self.marked, self.done = [], np.zeros(0), np.zeros(0, dtype=bool), 0

    def steps(self, final: bool) -> np.ndarray:
        raise NotImplementedError

    def cue(self, start: int, end: int) -> tuple:
        """(start, end, text) of a cue."""
        raise NotImplementedError

    def taken(self, text: str) -> list[str]:
        """The parts of a line."""
        return list(text)

    def feed(self, parts: list[str], time: np.ndarray, marked: np.ndarray) -> Iterator[tuple]:
        self.parts += parts
        self.time, self.marked = np.concatenate([self.time, time]), np.concatenate([self.marked, marked])
        if len(self.parts) >= self.lot:
            yield from self.cut(False)

    def cut(self, final: bool) -> Iterator[tuple]:
        sure = len(self.parts) if final else len(self.parts) - self.ahead
        jump = self.steps(final) if sure > 0 else ()
        at = 0
        while at < sure:
            end = int(jump[at])
            yield self.done + at, self.done + end, *self.cue(at, end), bool(self.marked[end - 1])
            at = end
        self.parts, self.time, self.marked, self.done = self.parts[at:], self.time[at:], self.marked[at:], self.done + at


class ReadingWalk(Walk):
    """Cues of 8 to 34 characters, best 20 in 3.1 seconds, gladly at marks and at preferred places; a rest of 30 stays whole."""

    ahead = 36
    low, high, rest = 8, 34, 30
    reach: float | None = None

    def steps(self, final: bool) -> np.ndarray:
        n, time = len(self.parts), self.time
        chars = np.frombuffer("".join(self.parts).encode("utf-32-le"), dtype=np.uint32)
        of = lambda marks: np.isin(chars, [ord(m) for m in marks])
        strong, weak, closing = of(STRONG), of(WEAK), of(CLOSERS)
        best, found = np.full(n, np.inf), np.minimum(n, np.arange(n) + 24)
        for length in range(self.low, min(self.high, n) + 1):
            m = n - length + 1
            last = np.arange(m) + length - 1
            seconds = time[last] - time[:m]
            cost = abs(length - 20) * 0.22 + abs(seconds - 3.1) * 1.1
            cost = cost - np.where(self.marked[last], 5.0, 0.0)
            cost = cost - np.where(strong[last], 3.0, np.where(weak[last], 1.2, 0.0))
            cost = cost + np.where(np.append(closing, False)[last + 1], 5.0, 0.0)
            cost[seconds < 0.75] = np.inf
            better = cost < best[:m]
            best[:m][better], found[:m][better] = cost[better], last[better] + 1
        if final:
            found[max(0, n - self.rest) :] = n
        return found

    def cue(self, start: int, end: int) -> tuple:
        begin = max(0.0, float(self.time[start]) - ROOM_MS / 1000, self.reach or 0.0)
        stop = float(self.time[end - 1]) + ROOM_MS / 1000
        self.reach = round(stop if stop > begin else begin + 0.12, 3)
        return round(begin, 3), self.reach, "".join(self.parts[start:end])


class TemplateWalk(Walk):
    """Cues of 24 kept characters, and on to 32 while they last less than 2.8 seconds. A part is a kept character with the
    others before it."""

    ahead = 34
    gap = ""

    def taken(self, text: str) -> list[str]:
        places = character_map(text)[1]
        begins = [0, *(p + 1 for p in places)]
        parts = [text[a : p + 1] if p >= a else "" for a, p in zip(begins, places)]
        if parts:
            parts[0], self.gap = self.gap + parts[0], text[places[-1] + 1 :] + "\n"
        else:
            self.gap += text + "\n"
        return parts

    def steps(self, final: bool) -> np.ndarray:
        n = len(self.parts)
        found = np.minimum(n, np.arange(n) + 24)
        for _ in range(32 - 24):
            more = (found < n) & (self.time[found - 1] - self.time < 2.8)
            found = np.where(more, found + 1, found)
        return found

    def cue(self, start: int, end: int) -> tuple:
        text = self.parts[start][-1:] + "".join(self.parts[start + 1 : end])
        return max(0.0, float(self.time[start]) - 0.06), float(self.time[end - 1]) + 0.06, text.strip()


def _walked(df: DataFrame, walk: Callable[[], Walk], key: str, until: str | None) -> DataFrame:
    """(key, from_char, to_char, start, end, text, preferred): cues of sorted media, streamed."""
    seconds = lambda name: F.col(name).cast("double").alias(name)
    preferred = (F.col("preferred") if "preferred" in df.columns else F.lit(None)).cast("array<int>").alias("preferred")
    lines = df.select(key, "pos", seconds("start"), seconds("end"), F.coalesce("text", F.lit("")).alias("text"), preferred, (F.col(until) if until else F.lit(None)).cast("double").alias("until"))
    lines = lines.where("start is not null and `end` is not null and text <> ''")
    schema = T._parse_datatype_string(f"{key} {dict(df.dtypes)[key]}, from_char int, to_char int, start double, end double, text string, preferred boolean")
    arrow = to_arrow_schema(schema)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(arrow)], schema=arrow)

    def run(batches):
        now, open_ = None, None
        for batch in record_parts(batches):
            out = []
            for media, _, start, end, text, marks, stop in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or media != now:
                    out += [(now, *cue) for cue in open_.cut(True)] if open_ is not None else []
                    now, open_ = media, walk()
                parts = open_.taken(text)
                n = len(parts)
                time = start + (max(start, end) - start) * (np.arange(n) + 0.5) / max(1, n)
                marked = np.zeros(n, dtype=bool)
                marked[[m - 1 for m in marks or () if m is not None and 0 < m <= n]] = True
                inside = 0 if open_.over else n if stop is None else int(np.searchsorted(time, stop, side="right"))
                open_.over |= inside < n
                out += [(media, *cue) for cue in open_.feed(parts[:inside], time[:inside], marked[:inside])]
            yield made(out)
        if open_ is not None:
            yield made([(now, *cue) for cue in open_.cut(True)])

    return lines.repartition(key).sortWithinPartitions(key, "pos", "start", "text").mapInArrow(run, schema)


def reading_cues(df: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, from_char, to_char, start, end, text, preferred) of each media's text, lines one after another without a line
    end; a column ``preferred`` names places within the line after which a break is good. Every character stands in one cue."""
    return _walked(df, ReadingWalk, key, None)


def template_cues(df: DataFrame, until: str | None = None, key: str = "media_id") -> DataFrame:
    """(key, from_char, to_char, start, end, text) over each media's kept characters; from the first one after the
    time in column ``until`` on they have no cue, and no cue ends after that time. text is what is written from its first kept character to its last."""
    cues = _walked(df, TemplateWalk, key, until)
    if until:
        ends = df.groupBy(key).agg(F.max(F.col(until).cast("double")).alias("_until"))
        cues = cues.join(ends, key, "left").withColumn("end", F.least("end", F.coalesce("_until", "end")))
    end = F.when(F.col("end") <= F.col("start"), F.col("start") + 0.1).otherwise(F.col("end"))
    return cues.select(key, "from_char", "to_char", "start", end.alias("end"), "text")
