"""Alignment of two long texts of a media: unique shared grams, their longest increasing chain, full matching in between.

Both sides are lines (media_id, pos, start, end, text), compared in their kept characters (see ``patches``). Matching whole
media with each other costs the product of their lengths; here

1. a gram of ``gram`` characters that a hash picks (one of ``thin``, the same on both sides) and that stands once in either
   text is a candidate pair of places,
2. the longest chain of candidates that increases on both sides is kept: the places alone, sorted, go through one task a
   media, 16 bytes a candidate,
3. neighbours on one diagonal whose grams touch are one block. What lies between two others is matched longest block first,
   each gap as a row of its own, spread over tasks. A gap holds few characters where the texts are alike; where they have no
   gram in common for long it is matched with the product of its sides.

Blocks are those of longest-block-first matching wherever the chain's places are in it, which holds for readings of one
recording; tests compare both.

Lines that are null, empty or without kept characters have no places; a media that only one side has no blocks.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.slices import record_parts
from ..sources.shared import written
from . import patches as pt
from .align import blocks as matching_blocks

KEY = "media_id"
#: Kept characters of a text whose grams are dealt one by one; those of a shorter one stay together.
LONG = 1 << 20


def held(lines: DataFrame, key: str = KEY) -> DataFrame:
    """Kept characters of lines as a table of short rows: lines (without their text) with ``n``, the kept characters of the
    line, ``text``, at most ``pt.PART`` of them, ``off``, the place of its first one in the line, and ``first``, in the
    media. The steps below read it several times; a character costs its own bytes there, and no more where rows are dealt.
    """
    others = [c for c in lines.columns if c != "text"]
    rows = lines.withColumn("_parts", pt.kept_parts("text")).where(F.size("_parts") > 0).select(*others, "_parts")
    rows = rows.withColumn("n", F.aggregate("_parts", F.lit(0), lambda n, p: n + F.length(p)))
    by = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.coalesce(F.sum(F.col("n").cast("long")).over(by), F.lit(0).cast("long")))
    rows = rows.select(*others, "n", "_first", F.posexplode("_parts").alias("_i", "text")).withColumn("off", F.col("_i") * pt.PART)
    return written(rows.select(*others, "n", "off", (F.col("_first") + F.col("off")).alias("first"), "text"), "held")


def _in_blocks(held: DataFrame, more: int, columns: list[str]) -> DataFrame:
    """columns, ``block``, and ``at`` and ``part``: held characters from a block's start to ``more`` behind its end."""
    end = F.col("first") + F.length("text")
    rows = held.withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("first") - more) / pt.BLOCK), F.floor((end - 1) / pt.BLOCK))))
    low = F.greatest(F.col("block") * pt.BLOCK, F.col("first"))
    high = F.least((F.col("block") + 1) * pt.BLOCK + more, end)
    part = F.substring("text", (low - F.col("first") + 1).cast("int"), (high - low).cast("int"))
    return rows.where(high > low).select(*columns, "block", low.alias("at"), part.alias("part"))


def _block_texts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, text) of rows in blocks; a block's text begins at its start."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "")
    return parts.groupBy(*keys, "block").agg(text.alias("text"))


def _candidates(parts: DataFrame, gram: int, thin: int, key: str) -> DataFrame:
    """(key, a, b): places of the picked grams that stand once in either side of a media."""
    texts = _block_texts(parts, [key, "side"]).where(F.length("text") >= gram)
    rows = texts.select(key, "side", "block", "text", F.explode(F.sequence(F.lit(0), F.length("text") - gram)).alias("i"))
    picked = rows.select(key, "side", F.substring("text", F.col("i") + 1, F.lit(gram)).alias("g"), (F.col("block") * pt.BLOCK + F.col("i")).alias("place")).where(F.pmod(F.xxhash64("g"), F.lit(thin)) == 0)
    own = lambda side, fn: fn(F.when(F.col("side") == side, F.col("place")))
    sums = picked.groupBy(key, "g").agg(own(0, F.count).alias("l"), own(1, F.count).alias("r"), own(0, F.min).alias("a"), own(1, F.min).alias("b"))
    return sums.where("l = 1 and r = 1").select(key, "a", "b")


def _chained(batches):
    """Of places sorted by media and a, those of a longest chain that increases in b."""
    now, key_type, key_name = None, None, None
    lefts, rights = array("q"), array("q")

    def made():
        tops, tails, back = array("q"), array("q"), array("q")
        for i, b in enumerate(rights):
            k = bisect_left(tops, b)
            back.append(tails[k - 1] if k else -1)
            tops[k : k + 1] = array("q", [b])
            tails[k : k + 1] = array("q", [i])
        at, kept = tails[-1] if tails else -1, array("q")
        while at >= 0:
            kept.append(at)
            at = back[at]
        kept.reverse()
        a, b = ([side[i] for i in kept] for side in (lefts, rights))
        return pa.RecordBatch.from_arrays([pa.array([now] * len(kept), key_type), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[key_name, "a", "b"])

    for batch in record_parts(batches):
        if key_type is None:
            key_type, key_name = batch.schema.field(0).type, batch.schema.field(0).name
        for media, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if media != now and lefts:
                yield made()
                lefts, rights = array("q"), array("q")
            now = media
            lefts.append(a)
            rights.append(b)
    if lefts:
        yield made()


def _runs(gram: int):
    """The chain's grams as stretches: those that follow each other on one diagonal, ``gram`` apart at most, are one."""

    def run(batches):
        for chain in _chained(batches):
            a, b = (chain.column(i).to_numpy() for i in (1, 2))
            step = np.diff(a)
            new = np.flatnonzero(np.concatenate([[True], (step != np.diff(b)) | (step > gram)]))
            last = np.concatenate([new[1:], [len(a)]]) - 1
            yield pa.RecordBatch.from_arrays([chain.column(0).take(pa.array(new)), pa.array(a[new]), pa.array(b[new]), pa.array(a[last] - a[new] + 1)], names=[chain.schema.names[0], "a", "b", "size"])

    return run


def runs(left: DataFrame, right: DataFrame, ends: DataFrame, gram: int = 12, thin: int = 4, key: str = KEY) -> DataFrame:
    """(key, a, b, size): stretches of the chained grams; ``ends`` (key, a, b) has the sizes of either side.

    The texts of a media are dealt by its key once, and its grams are taken, counted and chained where they are. Texts of
    more than ``LONG`` characters are dealt by block, and their grams by gram, so that only the chain is one task's.
    """
    parts = _in_blocks(left, gram - 1, [key, F.lit(0).alias("side")]).unionByName(_in_blocks(right, gram - 1, [key, F.lit(1).alias("side")])).where(F.col(key).isNotNull())
    long_ = F.broadcast(ends.where(F.greatest("a", "b") > LONG).select(key))
    together = _candidates(parts.join(long_, key, "left_anti").repartition(key), gram, thin, key)
    spread = _candidates(parts.join(long_, key, "left_semi"), gram, thin, key).repartition(key)
    chain = lambda pairs: pairs.sortWithinPartitions(key, "a", "b").mapInArrow(_runs(gram), f"{key} {dict(left.dtypes)[key]}, a long, b long, size long")
    return chain(together).unionByName(chain(spread))


def _gap_blocks(batches):
    for part in record_parts(batches):
        media, first_a, first_b, left, right = part.columns
        out = [(k, x + m.a, y + m.b, m.size) for k, (x, y, a, b) in enumerate(zip(*(c.to_pylist() for c in (first_a, first_b, left, right)))) for m in matching_blocks(a, b) if m.size]
        of, a, b, size = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([media.take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in (a, b, size))], names=[part.schema.names[0], "a", "b", "size"])


def aligned_blocks(l: DataFrame, r: DataFrame, gram: int = 12, thin: int = 4, key: str = KEY) -> DataFrame:
    """(key, a, b, size): equal stretches of kept characters of the texts that ``held`` gives of either side, in order,
    never crossing."""
    size = lambda held, name: held.groupBy(key).agg(F.max(F.col("first") + F.length("text")).alias(name))
    ends = written(size(l, "a").join(size(r, "b"), key), "ends")
    edge = lambda a, b, n: ends.select(key, a.alias("a"), b.alias("b"), F.lit(1).cast("long").alias("size"), F.lit(n).alias("edge"))
    before = F.lit(-1).cast("long")
    marks = runs(l, r, ends, gram, thin, key).withColumn("edge", F.lit(0)).unionByName(edge(before, before, -1)).unionByName(edge(F.col("a"), F.col("b"), 1))
    by = Window.partitionBy(key).orderBy("a", "edge")
    steps = written(marks.withColumns({"za": F.lead("a").over(by), "zb": F.lead("b").over(by)}), "steps")
    known = steps.where("edge = 0").select(key, "a", "b", "size")
    gaps = steps.select(key, (F.col("a") + F.col("size")).alias("a"), (F.col("b") + F.col("size")).alias("b"), "za", "zb").where("za > a and zb > b")

    def text(held: DataFrame, low: str, high: str, name: str) -> DataFrame:
        asked = gaps.select(key, F.col("a").alias("id"), F.col(low).alias("low"), F.col(high).alias("high"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / pt.BLOCK), F.floor((F.col("high") - 1) / pt.BLOCK))))
        met = asked.join(_block_texts(_in_blocks(held, 0, [key]), [key]), [key, "block"])
        at = F.greatest(F.col("low") - F.col("block") * pt.BLOCK, F.lit(0)).cast("int")
        part = F.substring("text", at + 1, (F.col("high") - F.col("block") * pt.BLOCK).cast("int") - at)
        parts = met.select(key, "id", F.struct("block", part.alias("part")).alias("_p")).groupBy(key, "id").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
        return parts.select(key, F.col("id").alias("a"), F.array_join(F.transform("_p", lambda p: p["part"]), "").alias(name))

    found = gaps.join(text(l, "a", "za", "left"), [key, "a"]).join(text(r, "b", "zb", "right"), [key, "a"])
    matched = found.select(key, "a", "b", "left", "right").mapInArrow(_gap_blocks, f"{key} {dict(l.dtypes)[key]}, a long, b long, size long")
    rows = known.unionByName(matched)
    order = Window.partitionBy(key).orderBy("a")
    new = F.coalesce((F.col("a") != F.lag(F.col("a") + F.col("size")).over(order)) | (F.col("b") != F.lag(F.col("b") + F.col("size")).over(order)), F.lit(True))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return written(rows.groupBy(key, "_run").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.sum("size").alias("size")).drop("_run"), "blocks")


def text_stats(media: DataFrame, l: DataFrame, r: DataFrame, found: DataFrame, key: str = KEY) -> DataFrame:
    """(key, left_chars, right_chars, matched, coverage, precision, similarity, length_ratio) of each media."""
    size = lambda pieces, name: pieces.groupBy(key).agg(F.sum(F.length("text").cast("long")).alias(name))
    rows = media.select(key).distinct().join(size(l, "left_chars"), key, "left").join(size(r, "right_chars"), key, "left").join(found.groupBy(key).agg(F.sum("size").alias("matched")), key, "left").fillna(0, ["left_chars", "right_chars", "matched"])
    a, b, m = F.col("left_chars"), F.col("right_chars"), F.col("matched")
    share = lambda x, y: F.round(x / F.greatest(F.lit(1), y), 6)
    return rows.select(key, a, b, m, share(m, a).alias("coverage"), share(m, b).alias("precision"), F.when(a + b == 0, 1.0).otherwise(F.round(2 * m / (a + b), 6)).alias("similarity"), share(b, a).alias("length_ratio"))


def _cut(found: DataFrame, held: DataFrame, at: str, name: str, also: list[str], key: str) -> DataFrame:
    """found (key, a, b, size, ...) cut where lines end, with ``name``, the line's times (start, span, n) and the place of
    the first character in it, and the line's columns ``also``. ``at`` is the side (a or b) that the lines stand on."""
    blocks = lambda first, size: F.explode(F.sequence(F.floor(first / pt.BLOCK), F.floor((first + size - 1) / pt.BLOCK))).alias("block")
    line = F.struct("start", (F.greatest("end", "start") - F.col("start")).alias("span"), "n", "off").alias(name)
    lines = held.select(key, *also, "first", F.length("text").alias("_n"), line, blocks(F.col("first"), F.length("text")))
    met = found.select("*", blocks(F.col(at), F.col("size"))).join(lines, [key, "block"])
    low = F.greatest(F.col(at), F.col("first"), F.col("block") * pt.BLOCK)
    high = F.least(F.col(at) + F.col("size"), F.col("first") + F.col("_n"), (F.col("block") + 1) * pt.BLOCK)
    ahead = low - F.col(at)
    own = {"a": F.col("a") + ahead, "b": F.col("b") + ahead, "size": high - low, name: F.col(name).withField("off", F.col(f"{name}.off") + low - F.col("first"))}
    # What was cut before begins later in its line now.
    own |= {c: F.col(c).withField("off", F.col(f"{c}.off") + ahead) for c in found.columns if c in ("left_line", "right_line") and c != name}
    return met.where(high > low).select(*[own.get(c, F.col(c)).alias(c) for c in found.columns], own[name].alias(name), *also)


def matched_lines(l: DataFrame, r: DataFrame, found: DataFrame, also: tuple[str, ...] = (), key: str = KEY) -> DataFrame:
    """(key, a, b, size, left_line, right_line, ``also`` of the right lines): matched stretches of one line on either side.
    The times of their characters follow from the lines, see ``with_times``."""
    return _cut(_cut(found, l, "a", "left_line", [], key), r, "b", "right_line", list(also), key)


def with_times(stretches: DataFrame) -> DataFrame:
    """Stretches as matched kept characters, with ``left_time``, ``right_time`` and ``error``."""
    rows = stretches.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    time = lambda line: F.col(f"{line}.start") + F.col(f"{line}.span") * (F.col(f"{line}.off") + F.col("_i") + 0.5) / F.col(f"{line}.n")
    rows = rows.withColumns({"left_time": time("left_line"), "right_time": time("right_line")}).drop("left_line", "right_line", "_i", "size", "a", "b")
    return rows.withColumn("error", F.col("right_time") - F.col("left_time"))


def timed_report(left: DataFrame, right: DataFrame, media: DataFrame, chunk: float = 300.0, key: str = KEY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(media, chunks, windows): how well the times of a reading (right, with a column ``chunk``) fit a timed baseline (left).

    media (key, matched, median_error, p90_error, max_error): absolute errors of matched characters, 3 places; p90 is the
    error at place int(0.9 n) - 1 of all in order. chunks (key, chunk, characters, matched, from_time, to_time,
    signed_error, absolute_error): by the reading's chunks; from and to are baseline times, errors medians. windows (key,
    window, start, end, characters, matched, coverage): the baseline in spans of ``chunk`` seconds of each media (key,
    duration). Where nothing matches, times and errors are 0.
    """
    l, r = held(left, key), held(right, key)
    # Stretches are dealt, and become characters only where their group is.
    stretches = written(matched_lines(l, r, aligned_blocks(l, r, key=key), ("chunk",), key), "stretches")
    pairs = with_times(stretches.drop("chunk").repartition(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("error")))
    ranked = pairs.withColumn("_n", place).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(key)))
    p90 = F.greatest(F.lit(0), F.floor(F.col("_all") * 0.9) - 1) + 1
    whole = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("matched"), F.median(F.abs("error")).alias("m"), F.max(F.when(F.col("_n") == p90, F.abs("error"))).alias("p"), F.max(F.abs("error")).alias("x"))
    zero = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 3).alias(name)
    report = media.select(key).join(whole, key, "left").select(key, F.coalesce("matched", F.lit(0).cast("long")).alias("matched"), zero(F.col("m"), "median_error"), zero(F.col("p"), "p90_error"), zero(F.col("x"), "max_error"))
    own = with_times(stretches.repartition(key, "chunk"))
    sums = own.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("matched"), F.min("left_time").alias("f"), F.max("left_time").alias("t"), F.median("error").alias("s"), F.median(F.abs("error")).alias("e"))
    chunks = r.groupBy(key, "chunk").agg(F.sum(F.length("text").cast("long")).alias("characters")).join(sums, [key, "chunk"], "left")
    chunks = chunks.select(key, "chunk", "characters", F.coalesce("matched", F.lit(0).cast("long")).alias("matched"), zero(F.col("f"), "from_time"), zero(F.col("t"), "to_time"), zero(F.col("s"), "signed_error"), zero(F.col("e"), "absolute_error"))
    spans = media.where("duration > 0").select(key, "duration", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration") / chunk).cast("int") - 1)).alias("window"))
    at = lambda t: F.floor(F.col(t) / chunk).cast("int").alias("window")
    place = F.explode(F.sequence(F.col("off"), F.col("off") + F.length("text") - 1)).alias("i")
    times = l.join(media.select(key, "duration"), key).select(key, "duration", "start", "end", "n", place)
    times = times.withColumn("t", F.col("start") + (F.greatest("end", "start") - F.col("start")) * (F.col("i") + 0.5) / F.col("n")).where("t < duration")
    there = times.groupBy(key, at("t")).agg(F.count(F.lit(1)).alias("characters"))
    hit = with_times(stretches.join(media.select(key, "duration"), key)).where("left_time < duration").groupBy(key, at("left_time")).agg(F.count(F.lit(1)).alias("matched"))
    spans = spans.join(there, [key, "window"], "left").join(hit, [key, "window"], "left").fillna(0, ["characters", "matched"])
    spans = spans.select(key, "window", (F.col("window") * F.lit(chunk)).alias("start"), F.least("duration", (F.col("window") + 1) * F.lit(chunk)).alias("end"), "characters", "matched", F.round(F.col("matched") / F.greatest(F.lit(1), F.col("characters")), 6).alias("coverage"))
    return report, chunks, spans
