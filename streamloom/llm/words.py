"""Vectorised word hashes: words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.

A word's hash takes its bytes eight at a time, as little-endian numbers, through a mixer that is one-to-one, and its length
at the end: all words of a batch go through a step at once. Words of up to eight bytes and equal length never share a hash;
long words are hashed one by one by XXH3. 64-bit hashes stand for words and shingles throughout.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The lowest 0 to 8 bytes of a number.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Words of more bytes than this are hashed one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    low = np.concatenate([LOWER[raw], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", low, strides=(1,))  # the eight bytes from each place on
    length = ends - starts
    out = mix(eight[starts] & KEEP[np.minimum(length, 8)])
    some = np.flatnonzero((length > 8) & (length <= LONG))
    at = 8
    while len(some):
        out[some] = mix(out[some] ^ (eight[starts[some] + at] & KEEP[np.minimum(length[some] - at, 8)]))
        at += 8
        some = some[length[some] > at]
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(low[starts[k] : ends[k]].data)
    return mix(out ^ length.astype(U))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a batch, in order, and the row of each."""
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64)
    word = ~SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    finish = word.copy()
    finish[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] |= word[inner]
    finish[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return _hashes(raw, starts, ends), rows


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set of k-word shingles as sorted distinct hashes, row after row, and the offsets of the rows.

    A row of fewer words, but at least one, has its whole sequence as its only shingle.
    """
    n = len(offsets) - 1
    h, rows = word_hashes(raw, offsets)
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    acc = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k):
        acc = mix(acc * U(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j])
    fits = rows[: len(acc)] == rows[k - 1 :] if len(acc) else np.zeros(0, bool)
    values, owner = acc[fits], rows[: len(acc)][fits]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        made = np.zeros(len(short), U)
        for j in range(k - 1):
            has = count[short] > j
            made[has] = mix(made[has] * U(0xC2B2AE3D27D4EB4F) + h[first[short[has]] + j] + U(count.dtype.type(1)))
        values, owner = np.concatenate([values, made]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)
