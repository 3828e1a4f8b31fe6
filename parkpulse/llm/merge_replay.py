"""Byte-level BPE by replaying the merges over the distinct words of a block of documents.

An inverted index leads from each pair of neighbouring tokens to the places in the distinct words
where it stands. Ranks are taken up in order; each merge touches only its places and their
neighbours. Documents then look up the ids of their words, so a word that stands a million times in
a block is merged once. Blocks are independent: no shuffle, and no key that could run hot.

Merges in different words do not see each other. So one array step takes the postings of a band of
ranks and applies, in every word, its lowest rank in that band; the band ends when none is left.
Within each word that is the order of ranks. A vocabulary may give a pair formed late a lower rank
than the merge that formed it; such a pair joins the band in hand, and ranks whose merge can form
one are applied at one place per word at a time, the leftmost, as the reference encoder does.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from parkpulse.llm.wordhash import distinct

#: Unicode's White_Space, as a character class.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it up to the next white space. The splitting pattern never joins a
#: character with white space after it, so it can be applied to each of these alone.
CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


class MergeTable:
    """Ranks of a vocabulary as pairs of token ids."""

    BANDS = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, late = {}, set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
                    late.update(r for r in (left, right) if r > rank)
        self.keys = np.array(sorted(pairs), np.int64)
        self.key_ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        tokens = sorted(ranks.items(), key=lambda item: item[1])
        self.none = tokens[-1][1] + 1
        #: Merges whose result may form a pair of lower rank.
        self.late = np.zeros(self.none + 1, bool)
        self.late[list(late)] = True
        self.lengths = np.zeros(self.none, np.int64)
        for token, rank in tokens:
            self.lengths[rank] = len(token)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(token for token, _ in tokens), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, `none` where they do not merge."""
        key = left << np.int64(32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.key_ranks[at], self.none)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        whole = [self.ranks.get(w) for w in words]
        parts = [w for w, r in zip(words, whole, strict=True) if r is None]
        flat, offsets = self._replay(parts)
        data, cuts = flat.tobytes(), (offsets * 4).tolist()
        pieces = (data[a:b] for a, b in zip(cuts, cuts[1:]))
        return [next(pieces) if r is None else r.to_bytes(4, "little") for r in whole]

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        token = self.first[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        if n == 0:
            return np.zeros(0, "<u4"), offsets
        word = np.repeat(np.arange(len(words)), sizes)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        filled = sizes > 0
        right[offsets[1:][filled] - 1] = -1
        left[offsets[:-1][filled]] = -1
        rank = np.full(n, self.none)
        inner = np.flatnonzero(right >= 0)
        rank[inner] = self.pair_ranks(token[inner], token[right[inner]])

        # The index: places by the rank of the pair that stands there.
        postings = np.flatnonzero(rank < self.none)
        postings = postings[np.argsort(rank[postings], kind="stable")]
        listed = rank[postings]
        highs = distinct(listed[np.linspace(0, len(listed) - 1, self.BANDS).astype(int)]) + 1 if len(listed) else []
        formed = np.zeros(0, np.int64)
        read = 0
        for high in [*highs, self.none]:
            stop = int(np.searchsorted(listed, high))
            now = rank[formed] < high
            todo = np.concatenate([postings[read:stop], formed[now]])
            later = [formed[~now]]
            read = stop
            while len(todo := todo[rank[todo] < high]):
                todo = distinct(todo)
                # In each word the places of its lowest rank, from left to right.
                todo = todo[np.lexsort((todo, rank[todo], word[todo]))]
                of, ranks = word[todo], rank[todo]
                head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                lowest = np.repeat(ranks[head], np.diff(np.append(head, len(todo))))
                take = ranks == lowest
                once = take & self.late[ranks]
                once[head] = False
                take &= ~once
                chosen = todo[take]
                # Where chosen places overlap, every other one.
                run = np.concatenate([[True], right[chosen[:-1]] != chosen[1:]])
                index = np.arange(len(chosen))
                chosen = chosen[(index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0]
                touched = self._merge(chosen, token, left, right, rank)
                later.append(touched)
                todo = np.concatenate([todo, touched])
            formed = np.concatenate(later)
            formed = formed[rank[formed] < self.none]
        alive = np.flatnonzero(token >= 0)
        return token[alive].astype("<u4"), np.concatenate([[0], np.cumsum(np.bincount(word[alive], minlength=len(words)))])

    def _merge(self, at, token, left, right, rank) -> np.ndarray:
        """Merge the pairs that begin at `at`; the places whose pair has changed."""
        after = right[at]
        token[at] = rank[at]
        token[after], rank[after] = -1, self.none
        beyond = right[at] = right[after]
        has = beyond >= 0
        left[beyond[has]] = at[has]
        before = left[at]
        before = before[before >= 0]
        rank[at] = self.none
        touched = distinct(np.concatenate([at[has], before[token[before] >= 0]]))
        touched = touched[right[touched] >= 0]
        rank[touched] = self.pair_ranks(token[touched], token[right[touched]])
        return touched

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.begins[ids] - (ends - sizes), sizes)]


class BlockEncoder:
    """Encodes blocks of texts; remembers at most `remember` chunks between blocks."""

    def __init__(self, table: MergeTable, pattern: str, remember: int = 250_000):
        self.table, self.pattern, self.remember = table, regex.compile(pattern), remember
        self.known: dict[str, np.ndarray] = {}

    def ids(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        chunked = list(map(CHUNK.findall, texts))
        new = set().union(*chunked).difference(known)
        split = self.pattern.findall
        parts = {chunk: split(chunk) for chunk in new}
        words = list(set(chain.from_iterable(parts.values())))
        merged = dict(zip(words, self.table.encode([w.encode() for w in words]), strict=True)).__getitem__
        join = b"".join
        known.update((chunk, merged(ws[0]) if len(ws) == 1 else join(map(merged, ws))) for chunk, ws in parts.items())
        return [np.frombuffer(join(map(known.__getitem__, chunks)), "<u4") for chunks in chunked]


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(read_ranks(path))
