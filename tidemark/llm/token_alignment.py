"""Cross-tokenizer alignment by a dictionary of groups.

A text is encoded by a byte-level tokenizer (A) and by a piece model (B). Byte offsets at which tokens of both end cut the
tokens into groups. There are far fewer distinct groups than groups, so they are interned:

1. Documents are taken apart in slices of about ``SLICE`` bytes. A slice cuts its texts into chunks that neither tokenizer
   looks across, encodes each distinct chunk once, and gives one row: its documents, how often each holds each of the
   slice's distinct groups, and those groups with their frequencies. The rows are written once.
2. All slices' groups meet by key, with a map-side combine. Each distinct group of the corpus is expanded into its links
   once, and a link counts as often as its group stands in the corpus.
3. What a group adds to a document joins the slices' groups by key and goes back to the slices, which sum it up.

Rows that travel: a slice's distinct groups, out and back, whatever the size of the corpus; a frequent group is one row a
slice. Chunks end before a space that follows a non-space: no token of A crosses such a place, as its pattern matches
non-spaces and then spaces nowhere; none of B, as long as no piece holds its space mark behind another character.

A link is a pair of tokens that end together (``rule="end"``), the last two of each group, or a pair whose bytes overlap
(``rule="overlap"``).

Texts that are null or empty, or whose tokens' bytes aren't a space and the text, have no tokens: zeros and ''. Rows stay
one to one, repeated rows and null ids too, and all count in the corpus; very long texts and words have no bound, though a
long text stands in one task; empty tables give empty results. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, spread, written
from .merges import PairTable, kept, replay
from .pretokens import packed, unpacked

#: Bytes of text of a slice.
SLICE = 8 << 20
#: A space, and on to the next space that follows a non-space.
CHUNK = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*")
#: The space mark of piece models.
MARK = "▁"


class ByteLevel:
    """Tokenizer A, of the text of a tokenizer file with byte-level merges. Special tokens are plain text.

    The merges run by rank of the joined token, which any two neighbours that join to it may use. That equals the file's
    listed pairs if those alone rebuild every token from its bytes: in a text, the merges inside a token's place are those
    of its bytes alone. ``check`` tells; it is run once, before anything else.
    """

    def __init__(self, definition: str, pattern: str):
        spec = json.loads(definition)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("A has plain byte-level pre-tokens")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("A has plain byte-level merges")
        self.table = PairTable.from_definition(definition)
        added = {t["content"] for t in spec.get("added_tokens") or []}
        own = {token: i for token, i in model["vocab"].items() if token not in added}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.ranks = {bytes(byte[c] for c in token): i for token, i in own.items()}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes = token_bytes({i: token for token, i in self.ranks.items()})

    def check(self) -> None:
        order = [joined for _, joined in sorted(self.table.pairs.values())]
        if any(a > b for a, b in zip(order, order[1:])):
            raise ValueError("A's ids don't follow the order of its merges")
        ids, counts = replay(list(self.ranks), self.table)
        if (counts != 1).any() or (ids != np.fromiter(self.ranks.values(), dtype=np.int64)).any():
            raise ValueError("A has tokens that its listed merges don't give")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), dtype=np.int64)


class Pieces:
    """Tokenizer B, of a serialized piece model."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.mark = self.library.piece_to_id(MARK)
        code = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = token_bytes({i: bytes([int(m[1], 16)]) if (m := code.fullmatch(p)) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)})

    def check(self) -> None:
        if self.whole:
            raise ValueError("B has pieces that reach across a space")
        if self.library.unk_id() == self.mark:
            raise ValueError("B has no piece for a space")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each text; the library adds the space, but not to an empty text."""
        found = [ids or [self.mark] for ids in self.library.encode(texts, num_threads=1)]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(counts.sum())), counts


def token_bytes(of: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and start of each id's bytes, and all bytes."""
    words = [of.get(i, b"") for i in range(max(of) + 1)]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return size, np.cumsum(size) - size, np.frombuffer(b"".join(words), dtype=np.uint8)


def laid_out(ids: np.ndarray, counts: np.ndarray, table: tuple, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each chunk's tokens give its bytes, and where each token ends in all chunks laid end to end, those right."""
    size, start, data = table
    sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    first = np.cumsum(counts) - counts
    total = np.concatenate([[0], np.cumsum(size[ids])])
    right = total[first + counts] - total[first] == sizes
    have = data[spread(start[ids], size[ids])]
    want = np.frombuffer(b"".join(chunks), dtype=np.uint8)
    own = np.repeat(right, sizes)
    same = np.zeros(len(want), dtype=bool)
    same[own] = have[np.repeat(np.repeat(right, counts), size[ids])] == want[own]
    wrong = np.concatenate([[0], np.cumsum(~same)])
    ends = np.cumsum(sizes)
    right &= wrong[ends] == wrong[ends - sizes]
    return right, total[1:] + np.repeat(ends - sizes - total[first], counts)


class Aligner:
    """Both tokenizers in a worker."""

    def __init__(self, definition: str, pattern: str, model: bytes):
        self.a, self.b = ByteLevel(definition, pattern), Pieces(model)

    def check(self) -> None:
        self.a.check()
        self.b.check()

    def chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of each chunk. Chunks that end in a non-space are encoded in one go."""
        sizes = np.fromiter((len(c.encode()) for c in chunks), dtype=np.int64, count=len(chunks))
        open_end = np.fromiter((c[-1].isspace() for c in chunks), dtype=bool, count=len(chunks))
        joint = self.a.encode("".join(c for c, odd in zip(chunks, open_end) if not odd))
        at = np.searchsorted(np.cumsum(self.a.bytes[0][joint]), np.cumsum(sizes[~open_end]), side="right")
        parts = np.split(joint, at[:-1]) if len(at) else []
        alone = iter([self.a.encode(c) for c, odd in zip(chunks, open_end) if odd])
        parts = iter(parts)
        found = [next(alone) if odd else next(parts) for odd in open_end]
        return (np.concatenate(found) if found else joint), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def groups(self, chunks: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which chunks are right; distinct group keys; the groups of all chunks and how many each has; its A and B tokens."""
        raw = [c.encode() for c in chunks]
        ids_a, n_a = self.chunk_ids(chunks)
        ids_b, n_b = self.b.encode([c[1:] for c in chunks])
        right_a, ends_a = laid_out(ids_a, n_a, self.a.bytes, raw)
        right_b, ends_b = laid_out(ids_b, n_b, self.b.bytes, raw)
        right = right_a & right_b
        use_a, use_b = np.repeat(right, n_a), np.repeat(right, n_b)
        ids_a, ends_a, ids_b, ends_b = ids_a[use_a], ends_a[use_a], ids_b[use_b], ends_b[use_b]
        both, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        first_a, first_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
        if not len(both):
            first_a = first_b = last_a
        single = (first_a == last_a) & (first_b == last_b)
        number = np.empty(len(both), dtype=np.int64)
        width = len(self.b.bytes[0])
        pairs, number[single] = np.unique(ids_a[last_a[single]] * width + ids_b[last_b[single]], return_inverse=True)
        keys = [f"{p // width}|{p % width}" for p in pairs.tolist()]
        more: dict[str, int] = {}
        text_a, text_b = ids_a.astype(str).tolist() if not single.all() else [], ids_b.astype(str).tolist() if not single.all() else []
        spots = np.flatnonzero(~single)
        for g, *cut in zip(spots.tolist(), first_a[spots].tolist(), last_a[spots].tolist(), first_b[spots].tolist(), last_b[spots].tolist()):
            key = ",".join(text_a[cut[0] : cut[1] + 1]) + "|" + ",".join(text_b[cut[2] : cut[3] + 1])
            number[g] = len(keys) + more.setdefault(key, len(more))
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        count = np.diff(np.searchsorted(both, ends, side="right"), prepend=0)
        return right, keys + list(more), number, count, n_a, n_b

    def links(self, key: str, rule: str) -> list[tuple[int, int]]:
        a, b = ([int(i) for i in side.split(",")] for side in key.split("|"))
        if rule == "end":
            ends_a, ends_b = (np.cumsum(t.bytes[0][ids]).tolist() for t, ids in ((self.a, a), (self.b, b)))
            at = dict(zip(ends_b, b))
            return [(i, at[e]) for i, e in zip(a, ends_a) if e in at]
        found, ia, ib, end_a, end_b = [], 0, 0, self.a.bytes[0][a[0]], self.b.bytes[0][b[0]]
        while True:
            found.append((a[ia], b[ib]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a:
                ia += 1
                end_a += self.a.bytes[0][a[ia]] if ia < len(a) else 0
            if step_b:
                ib += 1
                end_b += self.b.bytes[0][b[ib]] if ib < len(b) else 0
            if ia == len(a) or ib == len(b):
                return found


class Alignment:
    """The alignment of a table of texts. ``definition`` and ``model`` (1.5 and 0.5 MB here) are read on the driver and sent along."""

    def __init__(self, df: DataFrame, definition: str, pattern: str, model: bytes, rule: str = "end", id_col: str = "doc_id", text_col: str = "text"):
        if rule not in ("end", "overlap"):
            raise ValueError(f"no such rule: {rule}")
        Aligner(definition, pattern, model).check()
        shared = df.sparkSession.sparkContext.broadcast((definition, pattern, model))
        name = hashlib.md5(pattern.encode() + definition.encode() + model).hexdigest()

        def aligner() -> Aligner:
            return kept("align " + name, lambda: Aligner(*shared.value))

        def taken_apart(batch: pa.RecordBatch) -> pa.RecordBatch:
            docs, cells, keys, times = _slice(batch, aligner())
            return pa.RecordBatch.from_arrays([pa.array([docs], pa.binary()), pa.array([cells], pa.binary()), pa.array([keys], pa.list_(pa.string())), pa.array([times.tolist()], pa.list_(pa.int64()))], names=["docs", "cells", "keys", "times"])

        def expanded(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [aligner().links(key, rule) for key in batch.column(0).to_pylist()]
            place = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            a, b = (pa.array([link[side] for f in found for link in f], pa.int32()) for side in (0, 1))
            return pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), a, b], names=["key", "n", "a", "b"])

        cut = map_batches(id_and_text(df, id_col, text_col), taken_apart, "docs binary, cells binary, keys array<string>, times array<long>", most=SLICE)
        self.slices = written(cut.withColumn("slice", F.monotonically_increasing_id()), "aligned")
        self.places = self.slices.select("slice", F.posexplode(F.arrays_zip("keys", "times")).alias("place", "group")).select("slice", "place", "group.keys", "group.times")
        self.groups = self.places.groupBy(F.col("keys").alias("key")).agg(F.sum("times").alias("n"))
        self.links = written(map_batches(self.groups, expanded, "key string, n long, a int, b int", "key"), "links")

    def pairs(self) -> DataFrame:
        """(a, b, n, best): how many links hold an id pair, and whether none of its B id has more."""
        pairs = self.links.groupBy("a", "b").agg(F.sum("n").alias("n"))
        most = pairs.groupBy("b").agg(F.max("n").alias("most"))
        return pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
        pairs = self.pairs().withColumnRenamed("n", "count")
        told = self.links.join(pairs, ["a", "b"]).groupBy("key").agg(F.count(F.lit(1)).alias("links"), F.sum(F.col("best").cast("long")).alias("bests"), F.sum("count").alias("counts"))
        back = self.places.select("slice", "place", F.col("keys").alias("key")).join(told, "key").select(F.col("slice").alias("home"), "place", "links", "bests", "counts")

        def summed(rows: pa.Table, found: pa.Table) -> pa.Table:
            made = []
            for docs, cells in zip(rows["docs"], rows["cells"]):
                (docs,), (cells,) = unpacked([docs]), unpacked([cells])
                doc, group, times = (c.to_numpy() for c in cells.columns)
                sums = []
                for name in ("links", "bests", "counts"):
                    of = np.zeros(len(found), dtype=np.int64)
                    of[found["place"].to_numpy()] = found[name].to_numpy()
                    running = np.concatenate([[0], np.cumsum(of[group] * times)])
                    ends = np.searchsorted(doc, np.arange(docs.num_rows), side="right")
                    sums.append(pa.array(np.diff(running[ends], prepend=0)))
                made.append(pa.RecordBatch.from_arrays([*docs.columns[:4], *sums, docs.column(4)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
            return pa.Table.from_batches(made)

        schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return self.slices.select("slice", "docs", "cells").groupBy("slice").cogroup(back.groupBy("home")).applyInArrow(summed, schema)


def _slice(batch: pa.RecordBatch, aligner: Aligner) -> tuple[bytes, bytes, list[str], np.ndarray]:
    """Documents; (document, group, times) cells, in order of documents; distinct groups; how often each stands here."""
    local: dict[str, int] = {}
    number = local.setdefault
    own = [np.fromiter((number(c, len(local)) for c in (CHUNK.findall(" " + text) if text else ())), dtype=np.int64) for text in batch.column(1).to_pylist()]
    right, keys, groups, count, n_a, n_b = aligner.groups(list(local))
    own = [c if right[c].all() else c[:0] for c in own]
    sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    flat = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def per_doc(of: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of[flat])])[ends])

    first = np.cumsum(count) - count
    names = [keys[g] for g in groups.tolist()]
    texts = [";".join(names[s : s + n]) for s, n in zip(first.tolist(), count.tolist())]
    shas = [hashlib.sha256(";".join([texts[c] for c in chunks.tolist()]).encode()).hexdigest() if len(chunks) else "" for chunks in own]
    n_groups = per_doc(count)
    cell, times = np.unique(np.repeat(np.arange(len(own)), n_groups) * max(1, len(keys)) + groups[spread(first[flat], count[flat])], return_counts=True)
    doc, group = np.divmod(cell, max(1, len(keys)))
    docs = pa.RecordBatch.from_arrays([batch.column(0), pa.array(per_doc(n_a)), pa.array(per_doc(n_b)), pa.array(n_groups), pa.array(shas, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "sha"])
    cells = pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int32)), pa.array(group.astype(np.int32)), pa.array(times.astype(np.int32))], names=["doc", "group", "times"])
    totals = np.bincount(group, weights=times, minlength=len(keys)).astype(np.int64)
    held = np.flatnonzero(totals)  # groups of texts without tokens alone are none
    move = np.cumsum(totals > 0) - 1
    cells = cells.set_column(1, "group", pa.array(move[group].astype(np.int32)) if len(group) else pa.array([], pa.int32()))
    return packed(docs), packed(cells), [keys[g] for g in held.tolist()], totals[held]
