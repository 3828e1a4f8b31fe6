"""Exact deduplication: group by 128-bit content hash, compare the bytes, keep the best row.

Only DataFrame functions. Texts are equal when identical after deleting ASCII white space. Of equal
texts the row with the most code points stays, ties by the smallest doc_id.

* The bytes themselves are a grouping key next to the hash, so two texts with one hash never merge.
* Equal texts collapse on the map side before anything is shuffled: a text that fills a third of
  all rows costs one row per map task.
* The join that takes the decision back to every row moves hashes, not texts. Both of its sides are
  plain tables, so adaptive execution can cut the partition of a hot text.

Null text counts as empty. Rows repeated with one doc_id count one by one in group_size and share
their `kept`. A null doc_id never stays unless all of its group are null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkpulse.llm.shared import read_table, without_spaces, written

_TWO_63, _TWO_64 = "9223372036854775808", "18446744073709551616"


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _rank() -> Column:
    """One number per row, smaller for more code points, then for a smaller doc_id.

    A decimal can be updated in place, which keeps the aggregate hash-based.
    """
    shorter = (F.lit(2**31) - F.col("n_chars")).cast("decimal(11,0)")
    return shorter * F.lit(_TWO_64).cast("decimal(20,0)") + (
        F.col("doc_id").cast("decimal(20,0)") + F.lit(_TWO_63).cast("decimal(20,0)")
    )


def _doc_of(rank: Column) -> Column:
    two_64 = F.lit(_TWO_64).cast("decimal(20,0)")
    return (rank % two_64 - F.lit(_TWO_63).cast("decimal(20,0)")).cast("bigint")


def exact_dedup(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of `docs`."""
    text = F.coalesce(docs["text"], F.lit(""))
    plain = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.char_length(text).alias("n_chars"),
        without_spaces(docs["text"]).alias("plain"),
    )
    groups = written(
        plain.withColumn("hash", hash_of(F.col("plain")))
        .groupBy("hash", "plain")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(_rank()).alias("rank"))
        .select(
            "hash",
            F.sha2("plain", 256).alias("text_sha256"),
            "group_size",
            _doc_of(F.col("rank")).alias("keep_id"),
        )
    )
    rows = written(
        plain.select("doc_id", hash_of(F.col("plain")).alias("hash"), F.sha2("plain", 256).alias("text_sha256"))
    )
    return rows.join(groups, ["hash", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), ranked AS (
  SELECT doc_id, t,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM ranked
"""
