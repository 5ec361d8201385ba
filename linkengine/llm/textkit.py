"""Words and word hashes of whole Arrow text columns, by NumPy over the UTF-8 bytes.

Words are ``[^\\x20\\x09-\\x0D]+``.  A word's hash is a 64-bit polynomial over random byte values, finished by a mixer, so
that equal words have equal hashes in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes worked on at once; a longer document is a chunk of its own.
CHUNK = 1 << 20
_pow: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, CHUNK)
        for i, p in enumerate((_P, _P_INV)):
            steps = np.full(size, U(p))
            steps[0] = 1
            _pow[i] = np.multiply.accumulate(steps)
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    bufs = col.buffers()
    if not len(col) or bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, first word of each row and the number of words)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    cut = off[(off > 0) & (off < len(data))]
    begin[cut] = word[cut]
    end = word.copy()
    end[:-1] &= ~word[1:]
    end[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the number of words)."""
    s, e, first = spans(data, off)
    if not len(s):
        return np.zeros(0, U), first
    pw, inv = _powers(len(data) + 1)
    acc = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * pw[: len(data)], out=acc[1:])
    return mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(U)), first


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each word; the last ``n - 1`` starts have none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    g = np.full(m, U(n))
    for j in range(n):
        g += h[j : j + m] * _GRAM[j]
    return mix(g)


def shingle_sets(col: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each row of a text column, the sorted distinct hashes of its ``n``-word shingles, A-Z lower-cased.

    Fewer words than ``n`` make one shingle of the whole sequence; no words make an empty set.
    """
    data, off = buffers(col)
    for a, b in chunks(off):
        part = LOWER[data[off[a] : off[b]]]
        h, first = word_hashes(part, off[a : b + 1] - off[a])
        g = grams(h, n)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                yield np.unique(g[lo : hi - n + 1])
            elif hi > lo:
                yield grams(h[lo:hi], int(hi - lo))
            else:
                yield np.zeros(0, U)
