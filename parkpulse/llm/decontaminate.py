"""Benchmark decontamination by winnowed fingerprints.

Words are runs of letters, digits and other characters above ASCII, with A-Z in lower case. A
window is SPAN consecutive words of an item; an item of fewer words, but not none, is one window.

1. Of every run of SPAN - K + 1 k-gram hashes the least is kept, in items and documents alike. Two
   texts that share SPAN words share such a run, and so the hash kept from it: no shared window is
   missed. The hashes of the items reach all tasks as a filter of bounded size.
2. A document extends each hash that passes to the windows around it. A second filter, of window
   hashes, drops nearly all that are in no item. Windows of short items are their own fingerprints.
3. What is left is joined with the items' windows word by word, so the result is exact whatever the
   filters let through. Both join sides are plain tables, which lets adaptive execution cut the
   partition of a passage that very many documents share.

Null text has no words. Repeated rows are handled one by one. Items without words match nothing;
items that repeat a window count once per item_id; an item without item_id makes hits like any other
but is not among the items of a document. Other columns are ignored. An empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkpulse.llm.bloom import Bloom, bloom_of
from parkpulse.llm.shared import read_table, written
from parkpulse.llm.wordhash import ALNUM, rolling, slices, text_buffers, words

SPAN = 13
K = 6

_HITS = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("window", pa.string())]))


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Whether each hash is the least of some run of `width` hashes (of all, if they are fewer)."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, bool)
    width = min(width, n)
    least = np.lib.stride_tricks.sliding_window_view(grams, width).min(axis=1)
    padded = np.concatenate([np.zeros(width - 1, grams.dtype), least, np.zeros(width - 1, grams.dtype)])
    return grams == np.lib.stride_tricks.sliding_window_view(padded, width).max(axis=1)


def _window_text(data: bytes, begins, ends, at: int, size: int) -> str:
    return b" ".join([data[begins[i] : ends[i]] for i in range(at, at + size)]).decode()


def item_windows(benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """item_id, size, window, hash of the window, and with each item's first window its fingerprints."""

    def run(batches):
        for batch in batches:
            out = {"item_id": [], "size": [], "window": [], "hash": [], "prints": []}
            raw, at = text_buffers(batch.column(1))
            for i, item_id in enumerate(batch.column(0).to_pylist()):
                hashes, begins, ends, _ = words(raw, at[i : i + 2], ALNUM)
                n = len(hashes)
                if n == 0:
                    continue
                size = min(n, span)
                data = raw[at[i] : at[i + 1]].tobytes().lower()
                grams = rolling(hashes, k)
                prints = grams[winnow(grams, span - k + 1)] if n >= span else grams[:0]
                window_hashes = rolling(hashes, size).view(np.int64).tolist()
                out["item_id"] += [item_id] * len(window_hashes)
                out["size"] += [size] * len(window_hashes)
                out["window"] += [_window_text(data, begins, ends, j, size) for j in range(len(window_hashes))]
                out["hash"] += window_hashes
                out["prints"] += [prints.view(np.int64).tolist()] + [[]] * (len(window_hashes) - 1)
            yield pa.RecordBatch.from_pydict(
                out,
                pa.schema(
                    [("item_id", pa.string()), ("size", pa.int32()), ("window", pa.string()),
                     ("hash", pa.int64()), ("prints", pa.list_(pa.int64()))]
                ),
            )

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
        run, "item_id string, size int, window string, hash bigint, prints array<bigint>"
    )


def _candidates(hashes, ends_of_doc, prints: Bloom, windows: Bloom, short: list[int], span: int, k: int):
    """(at, size) of the windows that may be some item's."""
    found = []
    n = len(hashes)
    grams = rolling(hashes, k)
    kept = np.flatnonzero(winnow(grams, span - k + 1))
    kept = kept[prints.may_have(grams[kept])]
    if len(kept):
        marks = np.zeros(n + 1, np.int32)
        np.add.at(marks, np.maximum(kept - (span - k), 0), 1)
        np.add.at(marks, kept + 1, -1)
        at = np.flatnonzero(np.cumsum(marks[:n]) > 0)
        at = at[at + span <= ends_of_doc[at]]
        at = at[windows.may_have(rolling(hashes, span)[at])]
        found.append((at, np.full(len(at), span)))
    for size in short:
        near = rolling(hashes, size)
        at = np.flatnonzero(windows.may_have(near))
        at = at[at + size <= ends_of_doc[at]]
        found.append((at, np.full(len(at), size)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, size = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    return at[order], size[order]


def _document_hits(docs: DataFrame, prints: Bloom, windows: Bloom, short: list[int], span: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((prints, windows))

    def run(batches):
        prints, windows = sent.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for first, last in slices(offsets):
                hashes, begins, ends, of = words(raw, offsets[first : last + 1], ALNUM)
                n_words = np.diff(of)
                at, size = _candidates(hashes, np.repeat(of[1:], n_words), prints, windows, short, span, k)
                data = raw[offsets[first] : offsets[last]].tobytes().lower() if len(at) else b""
                doc = np.searchsorted(of, at, "right") - 1
                texts = [_window_text(data, begins, ends, a, s) for a, s in zip(at.tolist(), size.tolist(), strict=True)]
                hits = pa.StructArray.from_arrays(
                    [pa.array((at - of[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(texts, pa.string())],
                    ["at", "size", "window"],
                )
                lists = pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(last - first + 1)).astype(np.int32), hits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n_words.astype(np.int64)), lists.cast(_HITS)],
                    ["doc_id", "n_words", "hits"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, hits array<struct<at:int,size:int,window:string>>"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of `docs`."""
    items = written(item_windows(benchmark, span, k))
    prints = bloom_of(items.select(F.explode("prints").alias("p")), "p")
    windows = bloom_of(items, "hash")
    short = sorted(r.size for r in items.where(F.col("size") < span).select("size").distinct().collect())
    rows = written(
        _document_hits(docs, prints, windows, short, span, k).withColumn("row", F.monotonically_increasing_id())
    )
    found = (
        rows.select("row", F.inline("hits"))
        .join(items.select("window", "item_id"), "window")
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"),
            F.sort_array(F.collect_set("item_id")).alias("items"),
        )
        .select(
            "row",
            "items",
            F.expr(
                "aggregate(spans, named_struct('end', 0, 'hit', 0L), (a, s) -> named_struct("
                " 'end', greatest(a.end, s.at + s.size),"
                " 'hit', a.hit + greatest(0, s.at + s.size - greatest(a.end, s.at)))).hit"
            ).alias("hit"),
        )
    )
    n_hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
