"""Word shingles as 64-bit hashes, computed over the bytes of many documents at once."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlake.llm.common import SPACES, mix64

SHINGLE = 5
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
STEP = 0xD1342543DE82EF95
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_text(text: Column) -> Column:
    """The words with single blanks between them; two texts with equal words become equal."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


@functools.lru_cache(maxsize=2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of every word, and the range of words of every document (n + 1 numbers)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ~space & (np.concatenate([[True], space[:-1]]) | edge[:-1])
    end = ~space & (np.concatenate([space[1:], [True]]) | edge[1:])
    s, e = np.nonzero(start)[0], np.nonzero(end)[0] + 1
    up, down = powers(max(16, int(n - 1).bit_length()))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n])])
    h = mix64((upto[e] - upto[s]) * down[s] + (e - s).astype(np.uint64))
    return h, s, np.searchsorted(s, offsets)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles, in order, and how many each document has.

    A document of fewer than ``size`` words, but not none, has one shingle.
    """
    h, _, at = word_hashes(raw, offsets)
    n_words = np.diff(at)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    pos = np.arange(len(h)) - at[:-1][doc] if len(h) else np.zeros(0, np.int64)
    left = n_words[doc] - pos
    total, factor = np.zeros(len(h), np.uint64), 1
    for j in range(size):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - j)] = h[j:]
        total += np.where(left > j, part, np.uint64(0)) * np.uint64(factor)
        factor = factor * STEP % (1 << 64)
    valid = (left >= size) | ((pos == 0) & (n_words[doc] < size))
    found = mix64(total + np.minimum(left, size).astype(np.uint64))[valid]
    return found, np.bincount(doc[valid], minlength=len(n_words))
