"""Pieces of texts and merges by walks: the same pre-tokens and ids with less work."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from tidemark.llm import bpe, merges, pretokens

from .test_operators import odd_texts


@pytest.mark.parametrize("pattern", [P.PATTERN, r"\w+|\W", r" {2}|."])
def test_pieces_give_the_matches_of_the_text(pattern):
    rng = random.Random(5)
    cut, found = pretokens.Pieces(pattern), regex.compile(pattern).findall
    texts = [t for t in odd_texts() if t]
    for signs in ("ab 1'\n\t.", "a  \n", "  'sé1　\x85\x1c", "ab. ,;'s!?:", "aß中ºⅷ² ́."):
        texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 12))) for _ in range(5000)]
    for text in texts:
        assert [w for piece in cut.pieces(text) for w in cut.words(piece)] == found(text)


def test_pieces_recur():
    cut = pretokens.Pieces(P.PATTERN)
    assert P.PATTERN == pretokens.BYTE_LEVEL
    assert len(set(cut.pieces("so it is, " * 1000 + "so"))) == 4  # the first has no blank before it
    assert cut.alpha("wörd")


def test_short_words_are_not_looked_up_one_pair_at_a_time():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    table = merges.PairTable.from_ranks(ranks)
    table.pairs = Counted(table.pairs)
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoin é中") for _ in range(rng.randrange(14))) for _ in range(2000)]
    flat, counts = merges.replay([w.encode() for w in words], table)
    assert Counted.asked == 0
    library = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    cut = np.concatenate([[0], np.cumsum(counts)])
    assert all(flat[a:b].tolist() == library.encode_ordinary(w) for w, a, b in zip(words, cut, cut[1:]))


def test_short_and_long_words_keep_their_places():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    table = merges.PairTable.from_ranks(ranks)
    rng = random.Random(4)
    words = ["".join(rng.choice("ab ") for _ in range(rng.choice([0, 1, 2, 63, 64, 65, 66, 300]))) for _ in range(500)]
    flat, counts = merges.replay([w.encode() for w in words], table)
    cut = np.concatenate([[0], np.cumsum(counts)])
    assert all(flat[a:b].tolist() == library.encode_ordinary(w) for w, a, b in zip(words, cut, cut[1:]))
    assert [len(x) for x in merges.replay([], table)] == [0, 0]
