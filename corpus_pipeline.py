"""The corpus pipeline: five stages, each working on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`, whatever these are. Each result is written as Parquet and read again.

A row is a document, whatever its doc_id: stages that drop some give each row a key of its own, decide
and filter by that, and leave the key out of their result. So rows without a doc_id, or with one that
other rows have too, go only for their own text. Where one of several rows stays, it is the one with the
smallest doc_id; rows without come last. Null text has no language and goes in the first stage. An empty
table passes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parkpulse.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from parkpulse.llm.shared import read_table, shared_folder, written


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a key of its own for each row, written once so that it holds, and the key's name."""
    key = "row_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id())), key


def _by_key(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, which is the key, and text."""
    return docs.select(F.col(key).alias("doc_id"), "text")


def _all_but_first(groups: DataFrame, docs: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of rows of `groups` (gone_key, group) all but the first of each group by order, doc_id and key."""
    rank = F.struct(*order, F.col("doc_id").isNull(), F.col("doc_id"), F.col(key))
    ranks = docs.select(F.col(key).alias("gone_key"), rank.alias("rank"))
    rows = written(groups.join(ranks, "gone_key"))
    first = rows.groupBy("group").agg(F.min("rank").alias("first")).select(F.col(f"first.{key}").alias("gone_key"))
    return rows.join(first, "gone_key", "left_anti")


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose key is not among `gone` (gone_key), without the key."""
    gone = written(gone.select("gone_key"))
    return docs.join(gone, docs[key] == gone["gone_key"], "left_anti").drop(key)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go."""
    return language_id.with_language(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most code points stays."""
    docs, key = _keyed(docs)
    found = exact_dedup.exact_dedup(_by_key(docs, key)).where("group_size > 1")
    groups = found.select(F.col("doc_id").alias("gone_key"), F.col("keep_id").alias("group"))
    return _without(docs, key, _all_but_first(groups, docs, key, -F.char_length("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links one stays."""
    docs, key = _keyed(docs)
    linked = written(jaccard_join.jaccard_components(_by_key(docs, key), own_ids=True).where("component_id <> doc_id"))
    groups = linked.select(F.col("doc_id").alias("gone_key"), F.col("component_id").alias("group"))
    heads = linked.select(F.col("component_id").alias("gone_key"), F.col("component_id").alias("group")).distinct()
    return _without(docs, key, _all_but_first(groups.union(heads), docs, key))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more stands in benchmark windows go."""
    docs, key = _keyed(docs)
    found = decontaminate.decontaminate(_by_key(docs, key), read_table(spark, sf_dir, "benchmark"))
    return _without(docs, key, found.where("contaminated").select(F.col("doc_id").alias("gone_key")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode_tokens),
]

#: Language ID, the components of links and the merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{number}-{name}")
    return docs
