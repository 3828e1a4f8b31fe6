"""Words of whole Arrow text columns as 64-bit hashes, without a Python object per word.

A word is a maximal run of word bytes; which bytes those are is a 256-entry table. A-Z count as
a-z. The hash of a word is a polynomial in its bytes, read off one running sum over the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _table in (_BYTE, _BYTE_2):
    _table[65:91] = _table[97:123]

#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: UTF-8 bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def counted(x: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each stands (or the sum of its weights)."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    if weights is None:
        x = np.sort(x)
    else:
        order = np.argsort(x, kind="stable")
        x, weights = x[order], weights[order]
    begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    n = np.diff(np.append(begins, len(x))) if weights is None else np.add.reduceat(weights, begins)
    return x[begins], n


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `limit` bytes each; a longer document stands alone."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(
    raw: np.ndarray, at: np.ndarray, is_word: np.ndarray, cut: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, begins, ends, word offsets by document) of the documents between `at` in `raw`.

    begins and ends are byte positions relative to at[0]. `cut` marks bytes at which a word begins
    even if there is one before.
    """
    lo, hi = int(at[0]), int(at[-1])
    data, n = raw[lo:hi], hi - lo
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    inside = is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = at - lo
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    if cut is not None:
        before[cut] = False
        after[:-1][cut[1:]] = False
    begins = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[begins]) * down[begins])
    return hashes, begins, ends, np.searchsorted(begins, edges)


def other_hashes(raw: np.ndarray, at: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second hash of the words found by `words`, independent of the first."""
    data = raw[at[0] : at[-1]]
    if not len(data):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_2[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins])


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out + np.uint64(k))
