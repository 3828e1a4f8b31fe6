"""Byte-level BPE encoding and decoding of whole texts (`merge_replay` has the method).

Null text counts as empty; an empty text has no ids. Rows are independent, so ties, repeated rows
and extra columns change nothing; an empty table gives an empty result. Ids fit unsigned 32 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkpulse.llm.merge_replay import BlockEncoder, merge_table
from parkpulse.llm.shared import read_table
from parkpulse.llm.wordhash import slices, text_buffers

#: Bytes of text whose distinct words are merged together.
BLOCK_BYTES = 2 << 20


def _mapped(docs: DataFrame, path: str, pattern: str, schema: str, row: Callable) -> DataFrame:
    def run(batches):
        table = merge_table(path)
        encoder = BlockEncoder(table, pattern)
        for batch in batches:
            _, at = text_buffers(batch.column(1))
            texts = batch.column(1).fill_null("")
            for first, last in slices(at, BLOCK_BYTES):
                ids = encoder.ids(texts.slice(first, last - first).to_pylist())
                yield row(table, batch.column(0).slice(first, last - first), ids)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) by the rank file at `path`, which every executor must have."""

    def row(table, doc_ids, ids):
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
        return pa.RecordBatch.from_arrays([doc_ids, lists], ["doc_id", "ids"])

    return _mapped(docs, path, pattern, "doc_id bigint, ids array<int>", row)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data (binary): the bytes that `ids` stand for."""

    def run(batches):
        table = merge_table(path)
        for batch in batches:
            data = [table.decode(np.array(x or [], np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes without moving the ids."""

    def row(table, doc_ids, ids):
        digests = [hashlib.sha256(x.data).hexdigest() for x in ids]
        decoded = [hashlib.sha256(table.decode(x).data).hexdigest() for x in ids]
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, path, pattern, schema, row)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(
        read_table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
