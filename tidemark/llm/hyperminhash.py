"""HyperMinHash signatures: per bucket the leading zeros of the smallest hash and a few bits after its leading one."""

from __future__ import annotations

import numpy as np

#: 128 buckets of 16 bits: 6 for the leading zeros, 10 for the mantissa. Four registers make a band.
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
BAND = 4
EMPTY = np.uint16(0xFFFF)
NO_BAND = np.uint64(0xFFFFFFFFFFFFFFFF)

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xBF58476D1CE4E5B9)
MIX_3 = np.uint64(0x94D049BB133111EB)


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_2
    h = (h ^ (h >> np.uint64(27))) * MIX_3
    return h ^ (h >> np.uint64(31))


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers by set; ``hashes`` holds the distinct hashes of all sets one after another."""
    n = len(sizes)
    row = np.repeat(np.arange(n, dtype=np.int64), sizes)
    h = scrambled(hashes)
    slot = row * BUCKETS + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    rest = h << np.uint64(BUCKET_BITS) >> np.uint64(1)  # 63 bits, so that a float's exponent is never rounded up
    least = np.full(n * BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, slot, rest)
    full = least != np.iinfo(np.uint64).max
    value = np.maximum(least[full], np.uint64(1 << (MANTISSA + 1)))
    top = np.frexp((value >> np.uint64(MANTISSA)).astype(np.float64))[1] - 1 + MANTISSA  # place of the leading one, exact to MANTISSA bits below
    top = np.where((value >> top.astype(np.uint64)) > 1, top + 1, np.where((value >> top.astype(np.uint64)) == 0, top - 1, top)).astype(np.uint64)
    zeros = np.uint64(63) - top
    mantissa = (value >> (top - np.uint64(MANTISSA))) & np.uint64((1 << MANTISSA) - 1)
    out = np.full(n * BUCKETS, EMPTY, dtype=np.uint16)
    out[full] = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return out.reshape(n, BUCKETS)


def bands(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each band and whether any of its registers is filled."""
    raw = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), BUCKETS // BAND)
    number = np.arange(raw.shape[1], dtype=np.uint64) * MIX
    return scrambled(raw ^ scrambled(number + MIX)), raw != NO_BAND


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected estimate by row, and the number of buckets that it rests on.

    Two registers of disjoint sets agree by chance with probability n_a * n_b / (n_a + n_b)**2 * 2**-MANTISSA / (2 ln 2):
    the width of a register's cell is its value times 2**-MANTISSA / (2 ln 2) on average.
    """
    either = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    chance = n_a * n_b / np.maximum(1, n_a + n_b) ** 2 * 2.0**-MANTISSA / (2 * np.log(2))
    return (same / np.maximum(1, either) - chance) / (1 - chance), either
