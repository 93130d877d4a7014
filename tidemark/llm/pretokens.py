"""The distinct pre-tokens of a whole corpus, worked out once each, and brought back to the documents.

Texts are cut into pieces first, and a slice takes each of its distinct pieces apart once, however often it stands there
(see ``Pieces``).

1. Documents are dealt into slices of about ``SLICE`` bytes of text by a hash of the row, packed: a packet holds the rows
   of one batch that go to one slice, compressed. That exchange is used twice.
2. Each slice gives its distinct pre-tokens, dealt into parts by a hash of the pre-token, a packet a part. All slices' packets
   of a part meet in one task, which works each pre-token out once for the corpus. A frequent pre-token is there once a
   slice, however often it stands in texts.
3. The ids, or just their numbers, go back to their slices in packets, without the pre-tokens: a slice knows its own and
   their order.

The parts, like the slices, grow in number with the texts, so that a task's pre-tokens stay few.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, spread

#: Bytes of text of a slice of the corpus, and bytes of text for each part of its pre-tokens.
SLICE, PART = 4 << 20, 32 << 20

#: The pattern of byte-level files. A blank after something that is no white space always begins a match.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: What ends many pieces, and stands alone after letters.
_ENDS = frozenset(".,;:?!")

_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=_ZSTD) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(packets: pa.ChunkedArray | pa.Array) -> Iterator[pa.RecordBatch]:
    for packet in packets:
        yield from pa.ipc.open_stream(packet.as_buffer())


class Pieces:
    """Pieces of a text, and the pre-tokens of a piece; those of all its pieces, in order, are those of the text.

    By ``BYTE_LEVEL``, a text is cut at its blanks, unless one stands after white space: then, and by any other pattern, the
    text is one piece. A piece is what follows a blank; the first, which follows none, has a blank put before it."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.whole = regex.compile(r"\s " if pattern == BYTE_LEVEL else "").search
        points = np.delete(np.arange(0x110000, dtype="<u4"), np.s_[0xD800:0xE000]).view("<U1")
        letters = "".join(points[np.strings.isalpha(points)])
        # letters of Python are letters of the pattern too, if its tables of characters are not older
        self.alpha = str.isalpha if pattern == BYTE_LEVEL and regex.fullmatch(r"\p{L}+", letters) else lambda piece: False

    def pieces(self, text: str) -> list[str]:
        if self.whole(text):
            return [" " + text]
        pieces = text.split(" ")
        pieces[0] = " " + pieces[0]
        return pieces

    def words(self, piece: str) -> list[str]:
        if self.alpha(piece):
            return [" " + piece]
        if piece[-1:] in _ENDS and self.alpha(piece[:-1]):
            return [" " + piece[:-1], piece[-1]]
        return self.find(piece[1:] if piece[:1] == " " else " " + piece)


class Corpus:
    """(slice, packet) of rows (doc_id, text, ...), and the number of parts for their pre-tokens."""

    def __init__(self, rows: DataFrame):
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n_parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
        number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-total // SLICE))))
        self.packets = rows.select(number.alias("slice"), "*").mapInArrow(self._pack, "slice long, packet binary")

    @staticmethod
    def _pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(0).to_numpy()
            order = np.argsort(number, kind="stable")
            rows = batch.select(list(range(1, batch.num_columns))).take(pa.array(order))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(number[order])) + 1, [len(order)]])
            made = [packed(rows.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(number[order][cuts[:-1]]), pa.array(made, pa.binary())], names=["slice", "packet"])

    def valued(self, split: Callable[[], Pieces], replay: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], with_ids: bool) -> DataFrame:
        """(slice, part, packet): the ids of a slice's pre-tokens of a part, in their order, and how many each has."""
        n_parts = self.n_parts

        def distinct(table: pa.Table) -> pa.Table:
            cut = split()
            pieces: set[str] = set()
            for batch in _texts(table["packet"]):
                for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                    if text:
                        pieces.update(cut.pieces(text))
            words = list({w for piece in pieces for w in cut.words(piece)})
            order, parts, cuts = in_parts(words, n_parts)
            words = pa.array(words, pa.string()).take(pa.array(order))
            made = [packed(pa.RecordBatch.from_arrays([words.slice(a, b - a)], names=["word"])) for a, b in zip(cuts, cuts[1:])]
            number = table["slice"][0].as_py()
            return pa.table({"slice": pa.array([number] * len(made), pa.int64()), "part": pa.array(parts, pa.int64()), "packet": pa.array(made, pa.binary())})

        def work_out(batches):
            known: dict[str, int] = {}
            flat, sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
            for batch in slices(batches, "packet"):
                lots = [b.column(0).to_pylist() for b in unpacked(batch.column(2))]
                new = [w for w in dict.fromkeys(w for lot in lots for w in lot) if w not in known]
                known.update(zip(new, range(len(known), len(known) + len(new))))
                more, counts = replay(new)
                flat, sizes = np.concatenate([flat, more]) if with_ids else flat, np.concatenate([sizes, counts])
                start = np.cumsum(sizes) - sizes
                made = []
                for lot in lots:
                    at = np.fromiter(map(known.__getitem__, lot), dtype=np.int64, count=len(lot))
                    ids = flat[spread(start[at], sizes[at])] if with_ids else flat
                    row = [pa.array([narrow(sizes[at])]), pa.array([narrow(ids)])]
                    made.append(packed(pa.RecordBatch.from_arrays(row, names=["sizes", "ids"])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["slice", "part", "packet"])

        words = self.packets.groupBy("slice").applyInArrow(distinct, "slice long, part long, packet binary")
        return words.repartition(n_parts, "part").mapInArrow(work_out, "slice long, part long, packet binary")

    def joined(self, values: DataFrame, split: Callable[[], Pieces], made: Callable[..., pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
        """``made(rows, pre-tokens of each row one after another, how many each row has, sizes, ids)`` over the rows of each
        slice; a pre-token is its number, which ``sizes`` and ``ids`` (all ids of all pre-tokens) follow."""
        n_parts = self.n_parts

        def run(rows: pa.Table, found: pa.Table) -> pa.Table:
            cut = split()
            known: dict[str, int] = defaultdict(count().__next__)  # by first appearance; a text's own strings are let go at once
            batches, numbers, counts = list(_texts(rows["packet"])), [], []
            for batch in batches:
                own, size = [np.zeros(0, dtype=np.int32)], np.zeros(batch.num_rows, dtype=np.int64)
                for i, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                    pieces = cut.pieces(text) if text else ()
                    size[i] = len(pieces)
                    own.append(np.fromiter(map(known.__getitem__, pieces), dtype=np.int32, count=len(pieces)))
                numbers.append(np.concatenate(own))
                counts.append(size)
            local: dict[str, int] = defaultdict(count().__next__)
            lengths = array("q")

            def words() -> Iterator[list[str]]:
                for piece in known:
                    own = cut.words(piece)
                    lengths.append(len(own))
                    yield own

            flat = np.fromiter(map(local.__getitem__, chain.from_iterable(words())), dtype=np.int32)
            known.clear()
            own_words = np.array(lengths, dtype=np.int64)
            starts = np.cumsum(own_words) - own_words
            order, parts, _ = in_parts(list(local), n_parts)
            packets = dict(zip(found["part"].to_pylist(), found["packet"]))
            sizes, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
            for part in parts.tolist():
                (lot,) = unpacked([packets[part]])
                sizes.append(lot.column(0).values.to_numpy().astype(np.int64))
                ids.append(lot.column(1).values.to_numpy().astype(np.int32))
            place = np.empty(len(local), dtype=np.int64)
            place[order] = np.arange(len(local))
            flat = place[flat]
            del local, place, order
            sizes, ids = np.concatenate(sizes), np.concatenate(ids)

            def taken_apart(batch: pa.RecordBatch, own: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
                ends = np.concatenate([[0], np.cumsum(own_words[own])])[np.concatenate([[0], np.cumsum(size)])]
                return made(batch, flat[spread(starts[own], own_words[own])], np.diff(ends), sizes, ids)

            return pa.Table.from_batches(list(map(taken_apart, batches, numbers, counts)))

        return self.packets.groupBy("slice").cogroup(values.groupBy("slice")).applyInArrow(run, schema)


def in_parts(words: list[str], n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of words by part and then by themselves, so that either side of an exchange numbers them alike; the parts
    that have words, and where each begins and the last one ends."""
    data = [w.encode("utf-8") for w in words]
    part = np.fromiter(map(zlib.crc32, data), dtype=np.int64, count=len(words)) % n_parts
    order = pc.sort_indices(pa.array(data, pa.binary())).to_numpy()
    order = order[np.argsort(part[order], kind="stable")]
    parts, starts = np.unique(part[order], return_index=True)
    return order, parts, np.append(starts, len(words))


def narrow(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.uint16 if not len(numbers) or int(numbers.max()) < 1 << 16 else np.int32)


def _texts(packets: Iterable) -> Iterator[pa.RecordBatch]:
    """Rows in batches that a worker takes apart at a time."""
    return slices(unpacked(packets))


def sizes_of(batch: pa.RecordBatch) -> pa.Array:
    """Bytes of each text."""
    return pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).cast(pa.int64())
