"""Context-tree weighting over bytes, as array operations on counted 4-grams.

A byte is eight binary decisions from its highest bit; the bits already known name one of 255 nodes.
Each node has a tree of contexts: depth 0 sees nothing, depth 3 the three bytes before. Every
context estimates its bit by Krichevsky and Trofimov (KT); a context above depth 3 weighs its own
estimate and the product of those one byte deeper by a half each. With the counts of the training
texts fixed, the probability of a next bit mixes the KT estimates of its four contexts.

A 4-gram is three context bytes and the byte they precede, packed with the oldest byte on top. All
contexts of depth 2 and 3 of a 4-gram can be worked out wherever the 4-grams with its two latest
context bytes are; depths 0 and 1 have at most 256 and 65,536 places and are summed up from there.
"""

from __future__ import annotations

import numpy as np

DEPTH = 3
#: Stands before the first byte and after the last; no UTF-8 text holds it.
EDGE = 0xFF


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of gamma(x) for x > 0, to about 1e-12."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


_LOG_PI = float(np.log(np.pi))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that KT gives to a sequence with these counts."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - _LOG_PI - log_gamma(a + b + 1)


def kt_next(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Probability of the next bit."""
    return (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)


def log_weighted(kt: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    return np.logaddexp(kt, deeper) - np.log(2)


def _own_share(kt: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    """Weight of a context's own estimate after the training texts."""
    return 1 / (1 + np.exp(np.clip(deeper - kt, -700, 700)))


def four_grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-grams, offsets by document), one for each byte and one for the end of each document."""
    sizes = np.diff(at)
    n_docs = len(sizes)
    doc = np.repeat(np.arange(n_docs), sizes)
    padded = np.full(int(sizes.sum()) + 4 * n_docs, EDGE, np.uint32)
    padded[np.arange(len(doc)) + 4 * doc + 3] = data
    code = padded[:-3] << np.uint32(24) | padded[1:-2] << np.uint32(16) | padded[2:-1] << np.uint32(8) | padded[3:]
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    # The 4-grams of document d begin 3 places further on for each document before it.
    return code[np.arange(offsets[-1]) + 3 * np.repeat(np.arange(n_docs), sizes + 1)], offsets


class Shard:
    """Contexts of depth 2 and 3 of all 4-grams with certain two latest context bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """Distinct 4-grams; how often the training texts have each (0 for those only to be scored)."""
        self.n = len(grams)
        symbol = (grams & np.uint32(0xFF)).astype(np.int64)
        context = (grams >> np.uint32(8)).astype(np.int64)
        level = np.arange(8)
        node = (1 << level) | (symbol[:, None] >> (8 - level))
        self.bit = ((symbol[:, None] >> (7 - level)) & 1).astype(bool).ravel()
        key3 = (context[:, None] << 8 | node).ravel()
        counts = np.repeat(counts.astype(np.int64), 8)
        keys3, self.at3 = np.unique(key3, return_inverse=True)
        self.zeros3 = np.bincount(self.at3, np.where(self.bit, 0, counts), len(keys3))
        self.ones3 = np.bincount(self.at3, np.where(self.bit, counts, 0), len(keys3))
        weighted3 = log_kt(self.zeros3, self.ones3)
        self.keys2, up2 = np.unique(keys3 & 0xFFFFFF, return_inverse=True)
        self.at2 = up2[self.at3]
        self.zeros2 = np.bincount(up2, self.zeros3, len(self.keys2))
        self.ones2 = np.bincount(up2, self.ones3, len(self.keys2))
        self.deeper2 = np.bincount(up2, weighted3, len(self.keys2))
        self.kt2 = log_kt(self.zeros2, self.ones2)

    def upward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, zeros, ones, log weighted probability) summed by context of depth 1."""
        place, up1 = np.unique(self.keys2 & 0xFFFF, return_inverse=True)
        weighted2 = log_weighted(self.kt2, self.deeper2)
        sums = (np.bincount(up1, x, len(place)) for x in (self.zeros2, self.ones2, weighted2))
        return place, *sums

    def log10_probabilities(self, top: Top) -> np.ndarray:
        """Log10 of the probability of each 4-gram's last byte after the bytes before it."""
        p = kt_next(self.zeros3[self.at3], self.ones3[self.at3], self.bit)
        own = _own_share(self.kt2, self.deeper2)[self.at2]
        p = own * kt_next(self.zeros2[self.at2], self.ones2[self.at2], self.bit) + (1 - own) * p
        place = self.keys2[self.at2] & 0xFFFF
        for depth, at in ((1, place), (0, place & 0xFF)):
            own = top.own[depth][at]
            p = own * kt_next(top.zeros[depth][at], top.ones[depth][at], self.bit) + (1 - own) * p
        return np.log10(p).reshape(self.n, 8).sum(axis=1)


class Top:
    """Contexts of depth 0 and 1, from the sums of all shards."""

    def __init__(self, place: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray):
        dense = [np.bincount(place, x, 1 << 16) for x in (zeros, ones, deeper)]
        kt1 = log_kt(dense[0], dense[1])
        weighted1 = log_weighted(kt1, dense[2])
        node = np.arange(1 << 16) & 0xFF
        root = [np.bincount(node, x, 256) for x in (dense[0], dense[1], weighted1)]
        kt0 = log_kt(root[0], root[1])
        self.zeros, self.ones = {1: dense[0], 0: root[0]}, {1: dense[1], 0: root[1]}
        self.own = {1: _own_share(kt1, dense[2]), 0: _own_share(kt0, root[2])}
