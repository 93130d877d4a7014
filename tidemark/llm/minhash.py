r"""Near-duplicate documents by HyperMinHash.

A document's set holds the distinct shingles of ``shingle`` words (runs of ``[^\x20\x09-\x0D]``, A-Z lower-cased); with
fewer words, the whole sequence is its one shingle. Two documents are linked where the Jaccard similarity of their full
sets reaches ``threshold`` (a fraction of whole numbers, so that the bound is exact).

1. One pass makes each document's set, its digest and its HyperMinHash registers. Equal sets are one node from here on.
2. Bands of four registers bring candidates together. A pair at 0.8 shares none of the 32 bands with probability 5e-8.
3. In each bucket, every node meets the smallest (the pivot): a row a node, not a pair of each two. The collision-corrected
   estimate of the registers drops pairs more than 5.5 standard deviations below the bound; the others are compared on
   their full sets.
4. A bucket whose nodes now lie in one component is done. The nodes of the others, which a common passage may bring
   together in any number, go through an exact prefix join over their shingles, rare ones first: two documents meet only
   if they share one of their rarest. Pairs of different components that it leaves are compared on full sets.
5. Connected components of the links; the smallest id of each is kept.

Null texts and texts without words have an empty set and are linked with nothing. A row with a null id has no component
and is kept. Rows stay one to one; rows that repeat an id are one node that has all their texts. Other columns are left
behind.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from . import hyperminhash as hmh
from .common import id_and_text, map_batches, written
from .components import connected_components

#: Documents whose shingles say which ones are common, and how many common ones are told apart.
SAMPLE, COMMON = 32_768, 500_000
#: Standard deviations that the estimate may lie below the bound.
MARGIN = 5.5


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = out * hmh.MIX + h[j : len(h) - k + 1 + j]
    return np.unique(hmh.scrambled(out))


def _sets(size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, size) for t in batch.column(1).to_pylist()]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        registers = hmh.signatures(np.concatenate(found), sizes)
        digests = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(digests, pa.binary()), pa.array([r.tobytes() if n else None for r, n in zip(registers, sizes)], pa.binary())], names=["doc_id", "n_shingles", "digest", "registers"])

    return run


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, hmh.BUCKETS)


def _band_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, full = hmh.bands(_registers(batch.column(1)))
    node = np.repeat(batch.column(0).to_numpy(), full.sum(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(keys[full].view(np.int64)), pa.array(node)], names=["key", "node"])


def _cut(buckets: np.ndarray, bound: float) -> np.ndarray:
    return bound - MARGIN * np.sqrt(bound * (1 - bound) / np.maximum(1, buckets))


def _likely(bound: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _registers(batch.column(2)), _registers(batch.column(3))
            n_a, n_b = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            estimate, buckets = hmh.jaccard(a, b, n_a, n_b)
            keep = (estimate >= _cut(buckets, bound)) & (np.minimum(n_a, n_b) >= bound * np.maximum(n_a, n_b) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _common(rest: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of about ``SAMPLE`` documents, at most ``COMMON``, with their counts."""
    every = max(1, -(-rest.count() // SAMPLE))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.concatenate([shingles(t, shingle) for t in batch.column(0).to_pylist()])
        kinds, n = np.unique(found, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], names=["h", "n"])

    drawn = rest.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(every)) == 0).select("text")
    counts = map_batches(drawn, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy()[order]


def _prefix_pairs(rest: DataFrame, shingle: int, over: int, under: int) -> DataFrame:
    """(a, b), a > b: pairs of different components that may reach the bound, by an exact prefix join.

    All sets are put in one order, rare shingles first. Two sets of at least the bound share one among the first
    n - ceil(2t / (1 + t) n) + 1 of the smaller and the first n - ceil(t n) + 1 of the larger. Any order is exact; the
    order decides only how many candidates there are, so frequencies may come from a bounded sample.
    """
    shared = rest.sparkSession.sparkContext.broadcast(_common(rest, shingle))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        common, counts = shared.value
        parts = []
        for node, comp, text in zip(*(c.to_pylist() for c in batch.columns)):
            s = shingles(text, shingle)
            n = len(s)
            often = np.zeros(n, dtype=np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                often = np.where(common[at] == s, counts[at], 0)
            k = n - -(-over * n // under) + 1
            first = s[np.lexsort((s, often))[:k]]
            listed = np.arange(k) < n - -(-2 * over * n // (under + over)) + 1
            parts.append((first, np.full(k, node), np.full(k, comp), np.full(k, n), np.arange(k), listed))
        h, node, comp, n, place, listed = (np.concatenate(c) for c in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node), pa.array(comp), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(listed)], names=["h", "node", "comp", "n", "place", "listed"])

    tokens = written(map_batches(rest.select("node", "comp", "text"), _by_text(run), "h long, node long, comp long, n int, place int, listed boolean"), "tokens")
    mixed = tokens.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("h")
    tokens = tokens.join(mixed, "h")
    small = tokens.where("listed").select("h", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("px"))
    large = tokens.select("h", F.col("node").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("place").alias("py"))
    need = F.ceil((F.col("nx") + F.col("ny")) * over / (under + over) - 1e-9)
    fits = ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))) & (F.col("nx") * under >= F.col("ny") * over)
    ahead = 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) - 1 >= need
    pairs = small.join(large, "h").where((F.col("cx") != F.col("cy")) & fits & ahead)
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _by_text(run):
    return lambda batch: run(batch) if batch.num_rows else None


def _verified(size: int, over: int, under: int):
    def run(batches):
        kept: OrderedDict = OrderedDict()

        def of(node: int, text: str) -> np.ndarray:
            key = (node, hash(text))
            got = kept.get(key)
            if got is None:
                got = kept[key] = shingles(text, size)
                if len(kept) > 256:
                    kept.popitem(last=False)
            return got

        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            for i in range(batch.num_rows):
                x, y = of(a[i], ta[i]), of(b[i], tb[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both > 0 and both * under >= over * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def near_duplicates(df: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    bound = threshold[0] / threshold[1]
    docs = id_and_text(df, id_col, text_col)
    sets = written(map_batches(docs, _sets(shingle), "doc_id long, n_shingles long, digest binary, registers binary"), "sets")
    full = sets.where("doc_id is not null and n_shingles > 0")
    firsts = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    nodes = full.join(firsts, ["digest", "doc_id"]).select(F.col("doc_id").alias("node"), "n_shingles", "registers").distinct()
    nodes = written(nodes, "nodes")

    bands = nodes.select("node", "registers").mapInArrow(lambda batches: (_band_rows(b) for b in batches if b.num_rows), "key long, node long")
    buckets = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).where("pivot < most").select("key", "pivot")
    members = written(bands.join(buckets, "key").distinct(), "members")

    signs = nodes.select("node", "n_shingles", "registers")
    pairs = members.where("node > pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = pairs.join(signs.toDF("a", "n_a", "r_a"), "a").join(signs.toDF("b", "n_b", "r_b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b")
    tested = written(pairs.mapInArrow(_likely(bound), "a long, b long").distinct(), "pairs")

    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = written(docs.join(wanted, "doc_id", "left_semi").distinct(), "texts")

    def linked(candidates: DataFrame) -> DataFrame:
        sides = candidates.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        return sides.mapInArrow(_verified(shingle, *threshold), "a long, b long").distinct()

    links = written(linked(tested), "links")
    found = connected_components(links, "a", "b")

    # Buckets that hold more than one component: the exact prefix join looks for links between components.
    open_ = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = open_.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    rest = open_.join(mixed, "key").select("node", "comp").distinct()
    rest = written(rest.join(texts.toDF("node", "text"), "node"), "rest")
    more = _prefix_pairs(rest, shingle, *threshold).join(tested, ["a", "b"], "left_anti")
    more_links = written(linked(written(more, "pairs")), "links")
    final = found
    if not more_links.isEmpty():
        final = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more_links), "a", "b")

    named = firsts.withColumnRenamed("doc_id", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    every = sets.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return every.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
