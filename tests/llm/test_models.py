"""Language ID and scoring: held-out accuracy, mixtures, and the tree by its definition."""

import collections
import math
import zlib

import numpy as np
import pytest
from llm_helpers import ascii_lower, words_space
from pyspark.sql import functions as F

from parkpulse.llm import language_id as L
from parkpulse.llm import lm_scoring as S
from parkpulse.llm.context_tree import log_gamma


def test_held_out_accuracy(documents):
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    got = L.identify(documents).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_mixture_of_two_languages(documents):
    langs, p = L.fit(documents)
    text = {lang: " ".join(r.text for r in documents.where(F.col("lang") == lang).limit(8).collect()) for lang in ("en", "de")}
    raw = np.frombuffer((text["en"][:6000] + " " + text["de"][:3000]).encode(), np.uint8)
    bucket, _ = L.trigrams(raw, np.array([0, len(raw)]))
    chosen, share = L.mixture(bucket, p)
    assert {langs[i] for i in chosen} == {"en", "de"}
    assert dict(zip((langs[i] for i in chosen), share))["en"] == pytest.approx(2 / 3, abs=0.1)


def test_texts_without_letters_and_without_training(spark, documents, no_docs):
    odd = [(1, None), (2, ""), (3, "123 !? ½ ²"), (4, "é"), (5, "ab"), (None, "The and of that")]
    frame = spark.createDataFrame(odd, "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(frame, *L.fit(documents)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] != "und" and got[5][0] != "und" and got[None][0] == "en"
    assert {r.lang_pred for r in L.predict(frame, *L.fit(no_docs)).collect()} == {"und"}
    assert L.identify(no_docs).count() == 0
    assert L.with_language(no_docs).columns == no_docs.columns


def test_unlabelled_documents_stay(spark):
    rows = [(1, "plain words", None), (2, "漢字", None), (3, "12 !?", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in L.with_language(docs).collect()) == [1, 2]


# ---- scoring

EDGE = b"\xff"


def decisions(byte):
    return [((1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1) for i in range(8)]


class Tree:
    """Context-tree weighting by its definition, on dictionaries."""

    def __init__(self, texts):
        self.counts, self.deeper = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
        for text in texts:
            data = EDGE * 3 + text.encode() + EDGE
            for p in range(3, len(data)):
                for node, bit in decisions(data[p]):
                    for d in range(4):
                        self.counts[node, data[p - d : p]][bit] += 1
                        if d < 3:
                            self.deeper[node, data[p - d : p]].add((node, data[p - d - 1 : p]))
        self.known = {}

    def kt(self, key):
        a, b = self.counts.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, key):
        if key not in self.known:
            own = self.kt(key)
            if len(key[1]) < 3:
                below = sum(map(self.weighted, self.deeper[key]))
                own = max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)
            self.known[key] = own
        return self.known[key]

    def log10(self, text):
        data, total = EDGE * 3 + text.encode() + EDGE, 0.0
        for at in range(3, len(data)):
            for node, bit in decisions(data[at]):
                p = None
                for d in (3, 2, 1, 0):
                    key = node, data[at - d : at]
                    a, b = self.counts.get(key, (0, 0))
                    own = ((b if bit else a) + 0.5) / (a + b + 1)
                    if p is None:
                        p = own
                        continue
                    below = sum(map(self.weighted, self.deeper.get(key, ())))
                    share = 1 / (1 + math.exp(min(700, max(-700, below - self.kt(key)))))
                    p = share * own + (1 - share) * p
                total += math.log10(p)
        return total


def test_scores_by_definition(spark, corpus):
    rows = [(i, None if t is None else t[:300]) for i, t in corpus[:40] + corpus[-10:-2]]
    train = [ascii_lower(t or "") for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*words_space(t), None]
    counts = collections.Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    tree = Tree(train)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in S.score(frame).collect()}
    for i, t in rows:
        r, mine = got[i], tokens(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine), sum(counts[w] > 0 for w in mine), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine), abs=1e-8)
        assert r.score == pytest.approx(tree.log10(ascii_lower(t or "")), abs=1e-7)


def test_blocks_do_not_matter(spark, sf, docs):
    key = lambda r: (str(r.doc_id), r.n_tokens)
    one = sorted(S.score(docs, F.lit(1)).collect(), key=key)
    many = sorted(S.score(docs).collect(), key=key)
    assert [r[:5] for r in one] == [r[:5] for r in many]
    assert [r.score for r in one] == pytest.approx([r.score for r in many])


def test_scores_without_training_and_without_documents(spark, no_docs):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = S.score(spark.createDataFrame([(held, "ab")], "doc_id bigint, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0)
    assert row.base_score == pytest.approx(0.0) and row.score == pytest.approx(-24 * math.log10(2))
    assert S.score(no_docs).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.0, 1e3, 1e9])
    assert log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-11)
