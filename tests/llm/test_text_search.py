"""Decontamination and personal data, against plain restatements."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import base_spans, contamination

from parkpulse.llm import pii
from parkpulse.llm.decontaminate import decontaminate, winnow
from parkpulse.llm.shared import read_table


def test_contamination(spark, sf, docs, corpus):
    items = [(r.item_id, r.text) for r in read_table(spark, sf, "benchmark").collect()]
    items += [(9001, "The of, AND"), (9002, None), (9003, " .. "), (9004, "be"), (9005, items[0][1])]
    more = [(20_000, items[3][1] + " x " + items[4][1]), (20_001, "only be"), (20_001, "only be")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    extra = spark.createDataFrame([(i, t, "x", 1, True) for i, t in more], docs.schema)
    got = decontaminate(docs.union(extra), benchmark).collect()
    assert sorted(map(tuple, got)) == sorted(contamination(corpus + more, items))
    assert any(r.contaminated for r in got)


def test_contamination_of_nothing(spark, docs, no_docs, corpus):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    clean = decontaminate(docs, nothing).collect()
    assert len(clean) == len(corpus) and not any(r.contaminated for r in clean)
    assert decontaminate(no_docs, nothing).count() == 0


def test_items_without_item_id_contaminate(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + passage), (2, "short one here"), (3, "clean")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, passage), (None, "one here"), ("a", passage)], "item_id string, text string")
    for some, n_items in ((items, 1), (items.where("item_id IS NULL"), 0)):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate(docs, some).collect()}
        assert got == {1: (20, n_items, True), 2: (2, 0, True), 3: (0, 0, False)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=8, max_size=60), st.integers(0, 40), st.integers(0, 9))
def test_winnowing_never_misses_a_shared_run(values, at, other):
    """Any 8 neighbouring hashes that two sequences share have a kept hash in common."""
    x = np.array(values, np.uint64)
    run = x[min(at, len(x) - 8) :][:8]
    y = np.concatenate([[np.uint64(other)] * 3, run, [np.uint64(other + 1)] * 2]).astype(np.uint64)
    assert set(x[winnow(x, 8)]) & set(y[winnow(y, 8)]) & set(run)


PIECES = ["a", "b.c", "@", "x@y.z", "a@b.c@d.e", "1", "22", "255.1.2.3", ".", "+1 (017) 555-7713", " ", "-", "é", "🙂",
          "4845168114407329", "7536784127813050", "4111 1111 1111 1111", "5", "%", "a@b.c%x@d.e.f", "256.1.1.1",
          "1.2.3.4.5.6.7.8", "(", "\n", "+", "999"]


def test_personal_data(spark, docs, corpus):
    rnd = random.Random(4)
    rows = corpus + [(50_000 + i, "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12)))) for i in range(3000)]
    long = ["7" * 20_000 + " a" * 3, "a" * 40_000, "1.2." * 3000, "+1" + " " * 20_000, "x@y" + ".a" * 5000]
    rows += [(90_000 + i, t) for i, t in enumerate(long)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = pii.personal_data(frame).select("doc_id", pii._listed("base").alias("base"), pii._listed("spans").alias("spans"))
    got = {r.doc_id: r for r in found.collect()}
    for doc_id, text in rows:
        want = base_spans(text)
        assert got[doc_id].base == ",".join(want), text[:200]
        assert set(want) <= set(got[doc_id].spans.split(",") if got[doc_id].spans else [])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_the_method_adds_a_number_that_the_base_drops(spark):
    plain = [(i, f"call +1 (0{i % 90 + 10}) 555-{1000 + i} now") for i in range(300)]
    glued = (9999, "ring +1 (017) 555-7713 190.12.1.7 today")
    frame = spark.createDataFrame(plain + [glued], "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.personal_data(frame).select("doc_id", pii._listed("spans").alias("spans")).collect()}
    assert base_spans(glued[1]) == ["ip:23:33"] and "phone:8:22" in spans[9999]


def test_what_only_the_method_finds_may_be_frequent(spark):
    """Neighbouring cards and phones without a country code, at half of all numbers and with no base span at all."""
    two = "4111 1111 1111 1111 5500 0000 0000 0004"
    rare = [(i, f"paid {two} ok" if i % 2 else "paid 4111 1111 1111 1111 ok") for i in range(60)]
    rare += [(100 + i, f"phone (017) 555-{1000 + i} or 212-555-{2000 + i}" if i % 2 else f"phone +1 (017) 555-{1000 + i}") for i in range(60)]
    rare += [(200 + i, f"at 10.200.30.{i} and 123.456.78.{i}") for i in range(50)]
    for rows in (rare, [r for r in rare if r[0] % 2 and r[0] < 200]):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        found = pii.personal_data(frame).select("doc_id", pii._listed("spans").alias("spans"))
        spans = {r.doc_id: r.spans for r in found.collect()}
        assert {spans[i] for i, _ in rows if i < 100 and i % 2} == {"card:5:24,card:25:44"}
        assert {spans[i] for i, _ in rows if 100 < i < 200 and i % 2} == {"phone:6:20,phone:24:36"}
        assert all(spans[i] == f"ip:3:{len(t.split()[1]) + 3}" for i, t in rows if i >= 200)


def test_a_span_stays_if_only_a_dropped_one_overlaps_it(spark):
    spans = [(3, 20, 30, 0.1), (3, 10, 22, 0.2), (3, 0, 12, 0.3), (2, 40, 50, 0.2), (3, 40, 50, 0.2), (3, 41, 60, 0.2)]
    frame = spark.createDataFrame([(spans,), ([],)], "fine array<struct<kind:int,begin:int,end:int,score:double>>")
    got = [[(s.kind, s.begin, s.end) for s in r.kept] for r in frame.select(pii.apart("fine").alias("kept")).collect()]
    assert got == [[(3, 0, 12), (3, 41, 60), (3, 20, 30)], []]


def test_personal_data_of_nothing(no_docs):
    assert pii.personal_data(no_docs).count() == 0
