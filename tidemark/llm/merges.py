"""Merge replay over many words at once, by an inverted index from token pairs to their places.

All words lie in one flat list of tokens with links to both neighbours. The index names, for each pair that the words
hold (filed under its rank, which pairs of one joined token share), the places where it stands. The lowest rank in the
index is always taken next, its places from left to right; a merge looks up only the two pairs that its neighbours now
form and files them. As words don't touch each other, each gets its merges in its own order: lowest rank first, leftmost
of equals, and a merge that opens a pair of lower rank has it taken before anything else.

Short words, nearly all of them, go by arrays: the index is one sorted list of (rank, place). A walk through it takes the
first place of each word, all at once, and the pairs that these merges form are filed for the next walk. Walks are as many
as the merges of one word; a long word, which would need too many, goes by the same index in a heap, a merge at a time.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from .common import spread

#: Bytes of words that are merged together.
TOGETHER = 1 << 18

#: Bytes of the longest word that goes by walks.
SHORT = 64


class PairTable:
    """Rank and joined id of each pair that merges; ``whole`` has the words that are a token as they stand."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]], byte_ids: list[int], size: int, whole: dict[bytes, int] | None = None):
        self.size, self.byte_ids = size, np.array(byte_ids, dtype=np.int64)
        self.pairs = {a * size + b: (rank, joined) for a, b, rank, joined in pairs}
        self.whole = whole or {}
        keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        found = np.array(list(self.pairs.values()), dtype=np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        levels, level = np.unique(found[order, 0], return_inverse=True)
        self._keys, self._level = np.append(keys[order], -1), np.append(level, -1)
        self.joined = np.zeros(len(levels), dtype=np.int64)
        self.joined[level] = found[order, 1]
        self.first = self.levels(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def levels(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair's rank among all ranks, -1 where the pair doesn't merge; ``joined`` follows it."""
        keys = left * self.size + right
        at = np.searchsorted(self._keys[:-1], keys)
        return np.where(self._keys[at] == keys, self._level[at], -1)

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> PairTable:
        """Rank files: any two tokens merge whose bytes together are a token, at that token's rank; a whole word that is
        a token is taken as it is."""
        pairs = ((a, b, r, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None)
        return cls(pairs, [ranks[bytes([b])] for b in range(256)], max(ranks.values()) + 1, ranks)

    @classmethod
    def from_definition(cls, definition: str) -> PairTable:
        """Tokenizer files: the listed pairs merge, in the listed order. Bytes stand there as printable characters."""
        model = json.loads(definition)["model"]
        vocab = model["vocab"]
        split = lambda pair: pair.split(" ") if isinstance(pair, str) else pair
        pairs = ((vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(map(split, model["merges"])))
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(0x100, 0x200))
        char = {b: chr(b) for b in printable} | {b: chr(next(others)) for b in range(256) if b not in set(printable)}
        return cls(pairs, [vocab[char[b]] for b in range(256)], max(vocab.values()) + 1)


#: Tables of this worker. A worker serves many tasks, and building a table takes longer than a task's words.
_TABLES: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    if name not in _TABLES:
        if len(_TABLES) >= 8:
            _TABLES.pop(next(iter(_TABLES)))
        _TABLES[name] = make()
    return _TABLES[name]


def batches(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words in lots of about TOGETHER bytes; a longer word stands alone."""
    lot, size = [], 0
    for word in words:
        if lot and size + len(word) > TOGETHER:
            yield lot
            lot, size = [], 0
        lot.append(word)
        size += len(word)
    if lot:
        yield lot


def replay(words: list[bytes], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and how many each word has."""
    counts = np.ones(len(words), dtype=np.int64)
    if not words:
        return np.zeros(0, dtype=np.int32), counts
    whole = table.whole.get
    given = np.fromiter((whole(w, -1) for w in words), dtype=np.int64, count=len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lots = []
    for places, step in ((np.flatnonzero((given < 0) & (sizes <= SHORT)), _walked), (np.flatnonzero((given < 0) & (sizes > SHORT)), _replay)):
        done = [step(lot, table) for lot in batches([words[i] for i in places.tolist()])]
        if done:
            flat, own = map(np.concatenate, zip(*done))
            counts[places] = own
            lots.append((places, flat, own))
    start = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), dtype=np.int32)
    settled = given >= 0
    ids[start[settled]] = given[settled]
    for places, flat, own in lots:
        ids[spread(start[places], own)] = flat
    return ids, counts


def _walked(words: list[bytes], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(data)
    token, word = table.byte_ids[data], np.repeat(np.arange(len(words)), sizes)
    # one place more on either side, so that a neighbour that is not there (-1) can be written to
    after, before = np.append(np.arange(1, n + 1), -1), np.append(np.arange(-1, n - 1), -1)
    full = sizes > 0
    ends = np.cumsum(sizes)
    after[ends[full] - 1] = -1
    before[(ends - sizes)[full]] = -1
    level = np.full(n + 1, -1, dtype=np.int64)  # of the pair that stands at each place
    at = np.flatnonzero(after[:n] >= 0)
    level[at] = table.first[data[at].astype(np.int64) * 256 + data[at + 1]]
    at = at[level[at] >= 0]
    index = np.sort(level[at] << 32 | at)
    first = np.zeros(len(words), dtype=np.int64)
    while len(index):
        at = index & 0xFFFFFFFF
        own = word[at]
        first[own[::-1]] = at[::-1]  # the last one written stays
        taken = first[own] == at
        p = at[taken]
        q = after[p]
        r = after[q]
        token[p], token[q] = table.joined[index[taken] >> 32], -1
        after[p], after[q], before[r] = r, -1, p
        level[p] = level[q] = -1
        left = np.concatenate([before[p], p[r >= 0]])
        left = left[left >= 0]
        level[left] = table.levels(token[left], token[after[left]])
        rest = index[~taken]
        rest = rest[level[rest & 0xFFFFFFFF] == rest >> 32]
        left = left[level[left] >= 0]
        index = np.sort(np.concatenate([rest, level[left] << 32 | left]))
    left = token >= 0
    return token[left].astype(np.int32), np.bincount(word[left], minlength=len(words)).astype(np.int64)


def _replay(words: list[bytes], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = table.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    n = len(start)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    full = sizes > 0
    ends = np.cumsum(sizes)
    after[ends[full] - 1] = -1
    before[(ends - sizes)[full]] = -1
    token, after, before = start.tolist(), after.tolist(), before.tolist()
    size, find = table.size, table.pairs.get
    index: dict[int, list[int]] = {}
    joined: dict[int, int] = {}
    for p in np.flatnonzero(np.array(after) >= 0).tolist():
        got = find(token[p] * size + token[p + 1])
        if got is not None:
            rank = got[0]
            if rank in index:
                index[rank].append(p)
            else:
                index[rank], joined[rank] = [p], got[1]
    order = list(index)
    heapq.heapify(order)
    pop, push = heapq.heappop, heapq.heappush
    while order:
        rank = order[0]
        places = index[rank]
        if not places:
            pop(order)
            del index[rank]
            continue
        places.sort()  # a sorted list is a heap
        new = joined[rank]
        while places and order[0] == rank:
            p = pop(places)
            q = after[p]
            if q < 0:
                continue
            got = find(token[p] * size + token[q])
            if got is None or got[0] != rank:
                continue  # another merge has changed the pair
            r = after[q]
            token[p], token[q], after[p], after[q] = new, -1, r, -1
            if r >= 0:
                before[r] = p
            for left in (before[p], p):
                if left >= 0 and (right := after[left]) >= 0:
                    got = find(token[left] * size + token[right])
                    if got is not None:
                        other = got[0]
                        if other not in index:
                            index[other], joined[other] = [left], got[1]
                            push(order, other)
                        elif other == rank:
                            push(places, left)
                        else:
                            index[other].append(left)
    token = np.array(token, dtype=np.int64)
    left = token >= 0
    return token[left].astype(np.int32), np.bincount(word[left], minlength=len(words)).astype(np.int64)
