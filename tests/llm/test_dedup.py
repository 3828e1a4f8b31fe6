"""Exact deduplication and the n-gram Jaccard join, against plain restatements."""

import random
import re

import numpy as np
import pytest
from llm_helpers import components, sha
from pyspark.sql import functions as F

from parkpulse.llm import graph
from parkpulse.llm import jaccard_join as J
from parkpulse.llm.exact_dedup import exact_dedup


def plain_exact(corpus):
    groups = {}
    for doc_id, text in corpus:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    out = []
    for doc_id, text in corpus:
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[plain])[1]
        out.append((doc_id, keep, len(groups[plain]), keep == doc_id, sha(plain)))
    return sorted(out)


def test_exact(docs, corpus):
    assert sorted(map(tuple, exact_dedup(docs).collect())) == plain_exact(corpus)


def test_exact_survives_hash_collisions(docs, corpus):
    weak = exact_dedup(docs, lambda text: F.unhex(F.substring(F.md5(text), 1, 2)))
    assert sorted(map(tuple, weak.collect())) == plain_exact(corpus)


def test_exact_ties_repeats_and_missing_ids(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a b"), (4, "a b"), (None, "zz"), (9, None), (8, " ")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {
        (5, 4, 4, False), (3, 4, 4, False), (4, 4, 4, True), (None, None, 1, True), (9, 8, 2, False), (8, 8, 2, True)
    }


def test_exact_runs_no_python(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_nothing_in_nothing_out(no_docs):
    assert exact_dedup(no_docs).count() == 0
    assert J.jaccard_components(no_docs).count() == 0


def test_components_of_real_documents(docs, corpus):
    assert sorted(map(tuple, J.jaccard_components(docs).collect())) == components(corpus)


def near_copies(seed, n, words, edits):
    rnd = random.Random(seed)
    base = [rnd.choice(["the", "of"]) + str(rnd.randrange(10_000)) for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rnd.randrange(edits)):
            text[rnd.randrange(words)] = f"new{rnd.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [20_000, 8])
def test_near_copies_at_the_threshold(spark, monkeypatch, block):
    """A group around the threshold, cut into blocks and not; and a passage that others share."""
    monkeypatch.setattr(J, "BLOCK", block)
    texts = near_copies(1, 60, 120, 9) + near_copies(2, 25, 40, 5)
    texts += [texts[0][:300] + " " + " ".join(near_copies(100 + i, 1, 60, 1)) for i in range(15)]
    corpus = list(enumerate(texts)) + [(500, texts[7]), (501, texts[7].upper())]
    frame = spark.createDataFrame(corpus, "doc_id bigint, text string")
    assert sorted(map(tuple, J.jaccard_components(frame).collect())) == components(corpus)


def test_missing_ids_and_repeated_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(2, text), (2, text), (1, text), (None, text), (7, None), (8, " ")]
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(2, 6, 1), (2, 6, 1), (1, 6, 1), (None, 6, None), (7, 0, 7), (8, 0, 8)], key=str)


def test_prefixes_lengthen_with_cost():
    cheap, dear = np.full(20, 3.0), np.full(20, 1e5)
    assert J.matches_asked(cheap, 3.0) == 1 < J.matches_asked(dear, 3.0) <= J.MOST_MATCHES


def test_short_texts_of_frequent_shingles_link(spark):
    """8 words have 4 shingles; a word more, at either end, makes a link of exactly 4/5."""
    frequent = [(i, "a b c d e f g h") for i in range(3000)]
    rare = [(10_000 + i, " ".join(f"w{i // 2}x{j}" for j in range(8))) for i in range(100)]
    edited = [(20_000, "a b c d e f g h i"), (20_001, "z a b c d e f g h"), (20_002, "a b c d e f g i")]
    frame = spark.createDataFrame(frequent + rare + edited, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_components(frame).collect()}
    assert got == {i: 0 for i, _ in frequent + edited[:2]} | {i: i - i % 2 for i, _ in rare + edited[2:]}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(5, i) for i in range(200, 260)]
    links = spark.createDataFrame(path + star + [(1, 1)], "a bigint, b bigint").repartition(7)
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 5 for i in (5, *range(200, 260)))


def test_different_texts_of_one_id_keep_their_links(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    schema = "doc_id bigint, text string"
    of = lambda *data: sorted(map(tuple, J.jaccard_components(spark.createDataFrame(data, schema)).collect()), key=str)
    rows = [(1, a), (1, b), (2, a), (3, b + " x"), (4, a + " y"), (None, a)]
    assert of(*rows) == sorted([(1, 36, 1), (1, 36, 1), (2, 36, 1), (3, 37, 1), (4, 37, 1), (None, 36, None)], key=str)
    # Each row by its own text: one id, two components; an empty text beside a full one.
    rows = [(5, a), (5, b), (5, None), (2, a + " y"), (3, b), (3, b)]
    assert of(*rows) == sorted([(5, 36, 2), (5, 36, 3), (5, 0, 5), (2, 37, 2), (3, 36, 3), (3, 36, 3)], key=str)
