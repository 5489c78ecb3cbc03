"""Words of a text column as 64-bit hashes, many rows at a time.

A word is a maximal run of ASCII letters and digits and non-ASCII bytes;
callers lower-case the text in Spark first.  All work is on the bytes of an
Arrow column, so no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

from apidrift.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = True
_IS_WORD[128:] = True
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64 (kept between calls)."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 20)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[:n + 1]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and its row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = _IS_WORD[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; equal bytes give equal hashes."""
    n = len(data)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(_BASE, n)[:n], out=acc[1:], dtype=np.uint64)
    h = (acc[end] - acc[start]) * _power(_INV, n)[start]
    return mix64(h + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row, and their rows.

    A row with fewer words, but at least one, gives one shingle of them all.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    m = len(words)
    h = np.zeros(m, np.uint64)
    for k in range(width):
        take = np.zeros(m, np.uint64)
        if k < m:
            take[:m - k] = words[k:]
            if k:
                inside = np.zeros(m, bool)
                inside[:m - k] = row[k:] == row[:m - k]
                take[~inside] = 0
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + take + np.uint64(k + 1))
    pos = np.arange(m) - first[row] if m else np.zeros(0, np.int64)
    keep = (pos + width <= count[row]) | ((pos == 0) & (count[row] < width)) if m else np.zeros(0, bool)
    return h[keep], row[keep]
