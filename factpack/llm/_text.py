"""Vectorised words, hashes and shingles over the byte buffer of an Arrow string column.

White space is ``[\\x20\\x09-\\x0D]``: single bytes in UTF-8, as are A-Z, so words are found and
lower-cased on bytes. Hashes are 64-bit: a random odd-multiplier polynomial over a table of random
byte values, then a finaliser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_MULTIPLIER = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(_STEP)) | U(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        m, back = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
        m[0] = back[0] = 1
        _powers, _inverse = np.cumprod(m, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty), and len + 1 offsets into them."""
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a column: of word i ``doc[i]``, ``start[i]``, ``end[i]`` (bytes) and ``hash[i]``.

    ``bounds`` has len + 1 places: the words of row k are ``bounds[k]:bounds[k + 1]``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True, skip: np.ndarray | None = None):
        """``skip``: further bytes (a table of 256 flags) that stand between words, as white space does."""
        data, offsets = buffer(texts)
        self.data, self.offsets, n = (LOWER[data] if lower else data), offsets, len(data)
        space = SPACE[data] if skip is None else (SPACE | skip)[data]
        begins, ends = ~space, ~space
        inner = offsets[(offsets > 0) & (offsets < n)]
        if n:
            begins = begins.copy()
            begins[1:] &= space[:-1]
            begins[inner] = ~space[inner]
            ends = ends.copy()
            ends[:-1] &= space[1:]
            ends[inner - 1] = ~space[inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        if hashes:
            self.hash = self._hash(space)

    def _hash(self, space: np.ndarray) -> np.ndarray:
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        _grow(n + 1)
        values = BYTE_VALUES[self.data] * _powers[:n]
        values[space] = 0
        sums = np.add.reduceat(values, self.start)
        return mix(sums * _inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each n-word window, and the place of its first word."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        total = np.zeros(len(at), np.uint64)
        for j in range(n):
            total = (total + self.hash[at + j]) * U(_MULTIPLIER)
            total ^= total >> U(29)
        return mix(total + U(n)), at


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each row's lower-cased words, sorted, and len + 1 bounds.

    A row with fewer than n words has its whole sequence as its one shingle, one without words none.
    """
    words = Words(texts, lower=True)
    h, at = words.windows(n)
    rows, sizes = len(words.offsets) - 1, np.diff(words.bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    counts = np.bincount(words.doc[at], minlength=rows) if len(at) else np.zeros(rows, np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    whole = {}
    for k in short.tolist():
        total = U(len(words.hash[words.bounds[k] : words.bounds[k + 1]]))
        for x in words.hash[words.bounds[k] : words.bounds[k + 1]]:
            with np.errstate(over="ignore"):
                total = mix(np.array([total * U(_MULTIPLIER) + x], np.uint64))[0]
        whole[k] = np.array([total], np.uint64)
    sets = []
    for k in range(rows):
        a, b = bounds[k], bounds[k + 1]
        if b > a:
            one = np.sort(h[a:b])
            keep = np.ones(len(one), bool)
            keep[1:] = one[1:] != one[:-1]
            sets.append(one[keep])
        else:
            sets.append(whole.get(k, h[:0]))
    sizes = np.array([len(x) for x in sets], np.int64)
    return (np.concatenate(sets) if sets else h[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
