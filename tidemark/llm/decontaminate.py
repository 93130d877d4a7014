"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of the benchmark items: ``width`` consecutive words, or the whole of a shorter item. A block
is two adjacent words. For all patterns of one length the shift table says how far the search may jump after the block
it has read; most blocks of a text stand in no pattern and let it jump a whole window less one. At shift zero the
bucket of the suffix block names the patterns to compare, word by word. Single-word patterns have the word as block.

Nulls and texts without words have no words, no hits and are clean; items without words are no patterns. Rows stay one
to one, repeated rows too, and equal windows count for every item that holds them. Items with a null id are searched
too: together they are one item, a null at the end of ``items``, which counts there and adds nothing to joined names.
Other columns are left behind.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, uncarried, written

#: Bytes of benchmark text that one pass over the corpus searches for; a larger benchmark takes several passes.
PASS_BYTES = 8 << 20

_KEPT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_KEPT).split() if text else []


class Searcher:
    """Shift and suffix tables for patterns of each length."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = 13):
        windows: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            n = min(width, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                windows[n][tuple(words[i : i + n])].add(item)
        self.tables = []
        for n, patterns in windows.items():
            block = min(2, n)
            shift: dict = {}
            suffix: dict = defaultdict(list)
            for pattern, names in patterns.items():
                for end in range(block, n + 1):
                    key = pattern[end - block : end] if block == 2 else pattern[end - 1]
                    if n - end < shift.get(key, n):
                        shift[key] = n - end
                suffix[pattern[n - block :] if block == 2 else pattern[n - 1]].append((list(pattern), names))
            self.tables.append((n, block, shift, dict(suffix)))

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word intervals that occurrences cover, and the items that they come from."""
        found: list[tuple[int, int]] = []
        names: set = set()
        size = len(words)
        for n, block, shift, suffix in self.tables:
            jump = n - block + 1
            get = shift.get
            end = n
            while end <= size:
                key = (words[end - 2], words[end - 1]) if block == 2 else words[end - 1]
                step = get(key, jump)
                if step:
                    end += step
                    continue
                for pattern, items in suffix[key]:
                    if words[end - n : end] == pattern:
                        found.append((end - n, end))
                        names |= items
                end += 1
        found.sort()
        return found, names


def covered(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted intervals, joined where they meet."""
    out: list[tuple[int, int]] = []
    for a, b in intervals:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


SCHEMA = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def _search(docs: DataFrame, items: list[tuple[str, str | None]], width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, width))
    state: dict[str, Searcher] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "search" not in state:
            state["search"] = Searcher(*shared.value)
        counts, hits, items = [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            found, names = state["search"](words)
            counts.append(len(words))
            hits.append([{"start": a, "end": b} for a, b in covered(found)])
            items.append(sorted(names, key=lambda name: (name is None, name or "")))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "hits", "items"])

    return map_batches(docs, run, SCHEMA)


def _blocks(benchmark: DataFrame, most: int):
    """Items in blocks of at most ``most`` bytes (one item at least), streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        n = len(row["text"] or "")
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += n
    if block:
        yield block


def find_benchmark_words(df: DataFrame, benchmark: DataFrame, width: int = 13, pass_bytes: int = PASS_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, hits array<struct<start,end>> in words, items array<string>, n_hit, contaminated) of every document;
    with ``carried``, also text and those columns.

    A document is contaminated where ``n_hit > 0`` and at least a twentieth of its words is hit. Tables of at most
    ``pass_bytes`` of benchmark are broadcast; further blocks are searched in passes of their own and joined by row.
    """
    docs = id_and_text(df, id_col, text_col, carried)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    blocks = list(_blocks(items, pass_bytes)) or [[]]
    if len(blocks) == 1:
        found = _search(docs, blocks[0], width)
    else:
        # A row's own number joins its passes again; equal rows are told apart by it.
        docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        numbered = docs.select("doc_id", "text", F.struct("row", *(["carried"] if carried else [])).alias("carried"))
        every = reduce(DataFrame.unionByName, [_search(numbered, b, width) for b in blocks])
        together = ["doc_id", F.col("carried.row").alias("row")]
        found = every.groupBy(*together).agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("hits")).alias("all_hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        zero = F.array().cast("array<struct<start:int,end:int>>")

        def join_next(done, h):
            last = F.element_at(done, -1)
            return F.when((F.size(done) > 0) & (h["start"] <= last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"))))).otherwise(F.concat(done, F.array(h)))

        found = found.select("doc_id", "row", "n_words", F.aggregate(F.array_sort("all_hits"), zero, join_next).alias("hits"), "items")
        found = found.drop("doc_id").join(docs, "row").select("doc_id", "n_words", "hits", "items", *(["text", "carried"] if carried else []))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + (h["end"] - h["start"]).cast("long"))
    return uncarried(found).withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
