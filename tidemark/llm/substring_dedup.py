r"""Substring dedup by difference-cover anchors.

A window is ``width`` consecutive words (runs of ``[^\x20\x09-\x0D]``, unchanged). A word goes if a window that covers
it has the word sequence of a window that starts in a document with a smaller id.

Anchors are shorter windows at the positions whose remainder modulo ``period`` lies in a difference cover. For any two
positions there is a shift below the period that takes both into the cover, so two equal windows always hold an equal
anchor at the same place. The steps:

1. Texts equal to one of a smaller id are settled at once (every window of theirs repeats); one copy of each goes on.
2. Anchor hashes meet by value; those of two documents or more are shared. A task sends a hash once for each slice of
   text, however many of the slice's documents hold it, so a passage that a third of all documents share makes as many
   rows as there are slices.
3. Around shared anchors the match is extended: every window that holds one gets a 96-bit fingerprint, and the smallest
   document of each fingerprint is found the same way. Anchors decide only where to look.
4. Each document joins its repeated windows and drops the covered words.

The texts are dealt out by id once and that exchange serves steps 2, 3 and 4; no text travels by its content.

Null and empty texts have no words. A row with a null id is no source and keeps all its words. Rows stay one to one:
rows that repeat an id never remove each other's words, whatever their texts. Other columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import id_and_text, map_batches

#: Perfect difference sets: every remainder but 0 is a difference of two members in just one way.
PERFECT = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

#: Bytes of text whose equal hashes a task brings together before it sends them.
SLICE = 8 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def difference_cover(period: int) -> tuple[int, ...]:
    """Remainders of which any difference modulo ``period`` is the difference of two."""
    if period in PERFECT:
        return PERFECT[period]
    cover, seen = [0], {0}
    while len(seen) < period:
        best = max(range(period), key=lambda x: (len({d for c in cover for d in ((x - c) % period, (c - x) % period)} - seen), -x))
        seen |= {d for c in [*cover, best] for d in ((best - c) % period, (c - best) % period)}
        cover.append(best)
    return tuple(sorted(cover))


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() parts at just the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(odd: np.uint64) -> np.uint64:
    """Modulo 2**64."""
    return np.uint64(pow(int(odd), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


class Words:
    """Hashes of all words of a slice in one array, with the place of each in its document."""

    def __init__(self, texts: list[str | None]):
        parts = [words_of(t) for t in texts]
        self.sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.total = int(self.sizes.sum())
        self.hash = np.fromiter((xxh3_64_intdigest(w) for p in parts for w in p), dtype=np.uint64, count=self.total)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(parts)), self.sizes)
        self.pos = np.arange(self.total) - self.start[self.row]

    def windows(self, at: np.ndarray, length: int, base: np.uint64, values: np.ndarray | None = None) -> np.ndarray:
        """Polynomial hashes of ``length`` words from each position of ``at``, modulo 2**64."""
        up = powers(base, self.total)
        sums = np.zeros(self.total + 1, dtype=np.uint64)
        np.cumsum((self.hash if values is None else values) * up[:-1], out=sums[1:])
        down = powers(inverse(base), self.total)
        return mixed((sums[at + length] - sums[at]) * down[at])


def _direct_key(docs: np.ndarray) -> np.ndarray:
    return (docs.astype(np.uint64) * BASE_2).view(np.int64)


def _anchors(width: int, period: int):
    length = width - period + 1
    inside = np.zeros(period, dtype=bool)
    inside[list(difference_cover(period))] = True

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
        words = Words(batch.column(1).to_pylist())
        at = np.flatnonzero(inside[words.pos % period] & (words.pos + length <= words.sizes[words.row]) & (words.sizes[words.row] >= width))
        if not len(at):
            return None
        key = words.windows(at, length, BASE)
        doc = doc_ids[words.row[at]]
        order = np.lexsort((at, doc, key))
        key, doc, pos = key[order], doc[order], words.pos[at[order]]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(key)) - 1
        many = doc[firsts] != doc[lasts]  # two documents of this slice hold it
        direct = many[group]
        keys = np.concatenate([key[firsts].view(np.int64), _direct_key(doc[direct])])
        docs = np.concatenate([doc[firsts], doc[direct]])
        places = np.concatenate([pos[firsts], pos[direct]]).astype(np.int32)
        state = np.concatenate([many.astype(np.int8), np.full(int(direct.sum()), 2, dtype=np.int8)])
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs), pa.array(places), pa.array(state)], names=["key", "doc", "pos", "state"])

    return run


def _candidates(width: int, period: int):
    length = width - period + 1
    inside = np.zeros(period, dtype=bool)
    inside[list(difference_cover(period))] = True

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
        tkeys = batch.column(2).to_numpy(zero_copy_only=False)
        words = Words(batch.column(1).to_pylist())
        if words.total < width:
            return None
        lists = batch.column(3)
        given = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(doc_ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        fits = given + length <= words.sizes[row]
        flat = words.start[row[fits]] + given[fits]
        # the same anchor elsewhere in a document is shared too: a slice sends one place of it
        at = np.flatnonzero(inside[words.pos % period] & (words.pos + length <= words.sizes[words.row]))
        key = words.windows(at, length, BASE)
        tag = mixed(key ^ (words.row[at].astype(np.uint64) * BASE_2))
        wanted = np.isin(tag, tag[np.searchsorted(at, np.unique(flat))])
        shared = at[wanted]
        edge = np.zeros(words.total + 1, dtype=np.int64)
        first = np.maximum(words.start[words.row[shared]], shared - (width - length))
        np.add.at(edge, first, 1)
        np.add.at(edge, shared + 1, -1)
        near = np.cumsum(edge[:-1]) > 0
        at = np.flatnonzero(near & (words.pos + width <= words.sizes[words.row]))
        if not len(at):
            return None
        key = words.windows(at, width, BASE)
        more = (words.windows(at, width, BASE_2, mixed(words.hash)) >> np.uint64(32)).astype(np.uint32)
        row = words.row[at]
        doc = doc_ids[row]
        order = np.lexsort((at, doc, more, key))
        new = np.ones(len(at), dtype=bool)
        k, m, d = key[order], more[order], doc[order]
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = d > least  # a smaller document of this slice has it
        ask = order[~later]
        # a window that comes again at the next word (one word over and over) makes one row
        fresh = np.ones(len(ask), dtype=bool)
        fresh[1:] = (key[ask[1:]] != key[ask[:-1]]) | (more[ask[1:]] != more[ask[:-1]]) | (row[ask[1:]] != row[ask[:-1]]) | (at[ask[1:]] != at[ask[:-1]] + 1)
        run_first = np.flatnonzero(fresh)
        run_last = np.append(run_first[1:], len(ask)) - 1
        begin, end = words.pos[at[ask[run_first]]], words.pos[at[ask[run_last]]] + 1
        ask = ask[run_first]
        keys, mores = key[ask].view(np.int64), more[ask].view(np.int32)
        docs, tks = doc[ask], tkeys[row[ask]]
        known = np.sort(order[later])
        if len(known):
            place = at[known]
            cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(row[known]) != 0)) + 1
            a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(known)]]) - 1
            run_doc = doc[known[a]]
            keys = np.concatenate([keys, _direct_key(run_doc)])
            mores = np.concatenate([mores, np.zeros(len(a), dtype=np.int32)])
            docs, tks = np.concatenate([docs, run_doc]), np.concatenate([tks, tkeys[row[known[a]]]])
            begin = np.concatenate([begin, words.pos[place[a]]])
            end = np.concatenate([end, words.pos[place[b]] + 1])
        direct = np.zeros(len(keys), dtype=bool)
        direct[len(ask) :] = True
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(mores), pa.array(docs), pa.array(tks), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(direct)],
            names=["key", "more", "doc", "tkey", "first", "last", "direct"],
        )

    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _kept(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        tkeys = batch.column(2).to_pylist()
        copies = batch.column(3).to_pylist()
        lists = batch.column(4)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.cumsum(counts)])
        flat = lists.flatten()
        tk, first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        n_words, n_removed, spans, kept = [], [], [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            found = []
            if copies[i]:
                found = [(0, len(words))] if len(words) >= width else []
            elif counts[i]:
                own = slice(cut[i], cut[i + 1])
                mine = tk[own] == tkeys[i]
                a, b = first[own][mine], last[own][mine]
                order = np.argsort(a, kind="stable")
                for x, y in zip(a[order].tolist(), (b[order] + (width - 1)).tolist()):
                    if found and x <= found[-1][1]:
                        found[-1] = (found[-1][0], max(y, found[-1][1]))
                    else:
                        found.append((x, y))
            if found:
                at, rest = 0, []
                for a, b in found:
                    rest += words[at:a]
                    at = b
                rest += words[at:]
            else:
                rest = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(rest))
            spans.append([{"start": a, "end": b} for a, b in found])
            kept.append(b" ".join(rest))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return run


def remove_repeats(df: DataFrame, width: int = 50, period: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans array<struct<start,end>> in words, kept string): every document without its repeats."""
    if not 1 <= period <= width:
        raise ValueError("the period must not be longer than the window")
    rows = id_and_text(df, id_col, text_col)
    # Every branch below must see the same exchange: the same two columns, and no filter that only one of them pushes down.
    docs = rows.where("doc_id is not null").repartition("doc_id")
    tkey = F.hash("text").alias("tkey")
    # One copy of each text: the smallest id. Copies of a smaller id are settled without a look at their words.
    firsts = docs.groupBy(F.md5("text").alias("content")).agg(F.min("doc_id").alias("first_id"))
    firsts = firsts.groupBy(F.col("first_id")).agg(F.lit(True).alias("is_first"))
    seen = docs.join(firsts, docs["doc_id"] == firsts["first_id"], "left").select("doc_id", "text", "is_first")
    anchors = map_batches(seen.where("is_first").select("doc_id", "text"), _anchors(width, period), "key long, doc long, pos int, state byte", most=SLICE)
    by_key = Window.partitionBy("key")
    shared = (
        anchors.select("doc", "pos", "state", F.min("doc").over(by_key).alias("low"), F.max("doc").over(by_key).alias("high"), F.max("state").over(by_key).alias("most"))
        .where("low < high or most > 0")
        .groupBy("doc")
        .agg(F.collect_list("pos").alias("places"))
    )
    near = docs.join(shared, docs["doc_id"] == shared["doc"]).select("doc_id", "text", tkey, "places")
    windows = map_batches(near, _candidates(width, period), "key long, more int, doc long, tkey int, first int, last int, direct boolean", most=SLICE)
    by_window = Window.partitionBy("key", "more")
    repeated = (
        windows.withColumn("low", F.min("doc").over(by_window))
        .where("direct or low < doc")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("tkey", "first", "last")).alias("repeats"))
    )
    final = seen.join(repeated, seen["doc_id"] == repeated["doc"], "left").select("doc_id", "text", tkey, F.col("is_first").isNull().alias("copy"), "repeats")
    nameless = rows.where("doc_id is null").select("doc_id", "text", tkey, F.lit(False).alias("copy"), F.lit(None).cast(final.schema["repeats"].dataType).alias("repeats"))
    # In this order: a union keeps the aliases below its first branch, and there they would make another exchange.
    final = nameless.unionByName(final)
    return map_batches(final, _kept(width), "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")
