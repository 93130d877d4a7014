"""Token counts without ids.

The pieces of each distinct pre-token of the corpus are counted once, by the merges of the tokenizer file (see
``pretokens`` and ``merges``; the library itself takes about 25 microseconds a word for objects that aren't needed here).
The counts join the frequencies of the pre-tokens in each document, and frequency times pieces is summed. Special strings
inside a text (the added tokens of the file) count as the library has them by default: one id each.

Nulls and empty texts have zero tokens. Rows stay one to one, repeated rows and null ids too; very long texts and words
have no bound; empty tables give empty results. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text
from .merges import PairTable, kept, replay
from .pretokens import Corpus, Pieces, sizes_of


class Splitter(Pieces):
    """Pre-tokens and special strings of a text. ``definition`` is the text of a tokenizer file with byte-level pre-tokens."""

    def __init__(self, definition: str, pattern: str):
        spec = json.loads(definition)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        model = spec.get("model") or {}
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level merges are counted by pre-token")
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level files are counted by pre-token")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take their surroundings with them can't be cut out")
        super().__init__(pattern)
        special = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return super().pieces(text)
        return [piece for part in self.special.split(text) for piece in super(Splitter, self).pieces(part)]

    def marks(self, text: str) -> int:
        return len(self.special.findall(text)) if self.special else 0


def count_tokens(df: DataFrame, definition: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text. ``definition`` (1.5 MB here) is read on the driver and sent along."""
    Splitter(definition, pattern)  # a file that can't be counted so is an error before anything runs
    shared = df.sparkSession.sparkContext.broadcast(definition)
    name = hashlib.md5((pattern + definition).encode()).hexdigest()
    corpus = Corpus(id_and_text(df, id_col, text_col))

    def splitter() -> Splitter:
        return kept("split " + name, lambda: Splitter(shared.value, pattern))

    def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        table = kept("pairs " + name, lambda: PairTable.from_definition(shared.value))
        return replay([w.encode("utf-8", "surrogatepass") for w in words], table)

    def made(batch: pa.RecordBatch, word: np.ndarray, counts: np.ndarray, sizes: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        marks = splitter().marks
        n_tokens = np.fromiter((marks(t) if t else 0 for t in batch.column(1).to_pylist()), dtype=np.int64, count=batch.num_rows)
        pair, times = np.unique(np.repeat(np.arange(len(counts)), counts) * (len(sizes) + 1) + word, return_counts=True)
        row, word = np.divmod(pair, len(sizes) + 1)  # (document, pre-token) with its frequency
        if len(row):
            n_tokens += np.bincount(row, weights=times * sizes[word], minlength=len(counts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), sizes_of(batch), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return corpus.joined(corpus.valued(splitter, pieces, False), splitter, made, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
