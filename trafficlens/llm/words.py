"""Words and shingles of whole texts as 64-bit hashes, a batch of texts at a time.

A word is a run of bytes other than ASCII white space, with A-Z in lower case; UTF-8
needs no decoding for that. Hashes are polynomials over the bytes, taken from one running
sum for the whole batch and mixed. Two different words share a hash with a chance of
about one in 2^60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the base and of its inverse, made once and extended when needed."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            cls.up = np.concatenate(([U64(1)], np.cumprod(np.full(size, U64(_BASE)))))
            cls.down = np.concatenate(([U64(1)], np.cumprod(np.full(size, U64(_INVERSE)))))
        return cls.up, cls.down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not starts[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, starts[-1] - starts[0], starts[0]), starts - starts[0]


def chunks(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, behind the last, their bytes, their starts), whole texts only."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[starts[first]:starts[last]], starts[first:last + 1] - starts[first]
        first = last


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where the words of each text start and end."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(starts), np.int64)
    inner = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inner[1:-1])
    begins = inner[1:] & ~inner[:-1]
    ends = inner[:-1] & ~inner[1:]
    # A text's start also starts a word, and ends one before it.
    edges = starts[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    joined = edges[inner[edges] & inner[edges + 1]]
    begins[joined] = True
    ends[joined] = True
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _Powers.to(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUES[data] * up[:len(data)], out=sums[1:])
    hashes = (sums[end] - sums[begin]) * down[begin]
    return mix(hashes + (end - begin).astype(U64)), np.searchsorted(begin, starts)


def sequences(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring words of one text, and the text each belongs to.

    A text of fewer words gives one for all of its words; one without words gives none.
    """
    count = np.diff(bounds)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), made)
    first = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(bounds[:-1], made)
    if not len(first):
        return np.zeros(0, U64), owner
    padded = np.concatenate((hashes, np.zeros(n, U64)))
    factors = [U64(pow(_BASE, 2 * i + 3, 2**64)) for i in range(n)]
    out = np.zeros(len(first), U64)
    for i in range(n):
        out += padded[first + i] * factors[i]
    for k in np.flatnonzero(count[owner] < n):
        own = hashes[first[k]:first[k] + count[owner[k]]]
        out[k] = (own * np.array(factors[:len(own)], U64)).sum(dtype=U64) + U64(len(own))
    return mix(out), owner
