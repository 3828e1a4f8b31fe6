"""The pipeline against plain restatements of its stages; every registered query against its SQL."""

import re
import struct

import __spark_entry__
import corpus_pipeline
import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from llm_helpers import components, contamination, sha
from pyspark.sql import functions as F

from parkpulse.llm import catalog
from parkpulse.llm.merge_replay import read_ranks
from parkpulse.llm.shared import read_table


def plain_pipeline(rows, items):
    rows = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    best = {}
    for i, t in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[plain] = min(best.get(plain, (0, 0, "")), (-len(t), i, t))
    rows = [(i, t) for _, i, t in best.values()]
    first = {i: c for i, _, c in components(rows)}
    rows = [(i, t) for i, t in rows if first[i] == i]
    rows = [row for row, x in zip(rows, contamination(rows, items), strict=True) if not x[5]]
    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in sorted(rows):
        ids = public.encode_ordinary(t)
        out.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t)))
    return out


def test_whole_pipeline(spark, sf):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, sf, "benchmark").collect()]
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == plain_pipeline(rows, items)
    assert len(got) < len(rows)


def test_stages_keep_the_columns_and_one_of_repeated_rows(spark, sf, documents):
    docs = documents.selectExpr("*", "'x' AS kept", "1 AS component_id").union(
        documents.where("doc_id < 30").selectExpr("*", "'x' AS kept", "1 AS component_id")
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        docs = kept
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids))


def test_rows_without_or_with_one_doc_id_go_for_their_own_text(spark, sf):
    text = lambda n: " ".join(f"plain{n}x{j}" for j in range(40))
    passage = next(r.text for r in read_table(spark, sf, "benchmark").collect() if len(r.text.split()) > 20)
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3) + " end"), (None, passage)]
    rows += [(7, text(3)), (7, text(4)), (7, text(5)), (8, text(5)), (9, text(6)), (6, text(6) + " end"), (7, passage + " x")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, Row_Key string").withColumn("lang", F.lit("en")).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    want = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(5)), (6, text(6) + " end")]
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want, key=str)


def test_stages_of_nothing(spark, sf, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).count() == 0, name


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) != 1] == []


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("benchmark", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    frame = catalog.queries()[name](spark, sf)
    columns = ", ".join(frame.columns)
    want = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(want, key=str)
