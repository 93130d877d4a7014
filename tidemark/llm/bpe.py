"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of the whole corpus are merged together (see ``pretokens`` and ``merges``): an inverted index
from token pairs to places, merges in rank order, only touched neighbours looked up again. Each pre-token is merged once;
its ids go back to the slices of documents that hold it. The texts travel once.

Nulls and empty texts give no ids. Rows stay one to one, repeated rows and null ids too; very long texts and words have no
bound; empty tables give empty results. Other columns are left behind.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, list_array, spread, uncarried
from .merges import PairTable, kept, replay
from .pretokens import Corpus, Pieces


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line. It is read on the driver and sent with the job (about 1 MB)."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}


def _ids(words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    """The ids of each text, from the ids of each pre-token."""
    own = sizes[words]
    ends = np.concatenate([[0], np.cumsum(own)])
    return list_array(ids[spread((np.cumsum(sizes) - sizes)[words], own)], np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text; with ``carried``, also text and those columns."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.md5(repr(sorted(ranks.items())).encode()).hexdigest()
    rows = id_and_text(df, id_col, text_col, carried)
    corpus = Corpus(rows)
    along = [c for c in ("text", "carried") if carried]

    def split():
        return kept("pieces " + pattern, lambda: Pieces(pattern))

    def merged(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        table = kept(name, lambda: PairTable.from_ranks(shared.value))
        return replay([w.encode("utf-8", "surrogatepass") for w in words], table)

    def made(batch: pa.RecordBatch, words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        found = [batch.column(0), _ids(words, counts, sizes, ids), *(batch.column(batch.schema.get_field_index(c)) for c in along)]
        return pa.RecordBatch.from_arrays(found, names=["doc_id", "ids", *along])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), *(rows.schema[c] for c in along)])
    return uncarried(corpus.joined(corpus.valued(split, merged, True), split, made, schema))


def decode(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, decoded binary, and ``carried`` columns): the bytes that the ids stand for; a null list gives none, an unknown id is an error."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    state: dict[str, np.ndarray] = {}

    def tables() -> dict[str, np.ndarray]:
        if not state:
            top = max(shared.value.values()) + 1
            words = [b""] * top
            for token, rank in shared.value.items():
                words[rank] = token
            state["size"] = np.fromiter(map(len, words), dtype=np.int64, count=top)
            state["start"] = np.cumsum(state["size"]) - state["size"]
            state["bytes"] = np.frombuffer(b"".join(words), dtype=np.uint8)
        return state

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # ids take more room than their text
                batch = whole.slice(at, 512)
                t = tables()
                lists = batch.column(1)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(t["size"])):
                    raise ValueError("an id is not in the vocabulary")
                sizes = t["size"][ids]
                data = t["bytes"][spread(t["start"][ids], sizes)]
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
                if ends[-1] >= 2**31:
                    made = pa.array([data[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
                else:
                    made = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, made, *batch.columns[2:]], names=names)

    also = [F.struct(*carried).alias("carried")] if carried else []
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"), *also)
    names = ["doc_id", "ids", "decoded", *picked.columns[2:]]
    kind = T._parse_datatype_string("doc_id long, ids array<int>, decoded binary")
    return uncarried(picked.mapInArrow(run, T.StructType([*kind, *picked.schema[2:]])))
