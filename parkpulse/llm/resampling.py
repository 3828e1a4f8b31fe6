"""Importance resampling towards a target distribution, over hashed words and word pairs.

Two passes over the texts. The first counts the features of the documents and of the target by
bucket, in an array per task; Spark adds the arrays up, and the gains, one number per bucket, go to
every task. The second pass looks the gains of a document's features up in that array and writes a
narrow table of weights and scores. A score is the weight with Gumbel noise, so the highest scores
are a draw without replacement in proportion to the weights.

The lowest drawn score is found by bisection: exact counts over the written scores, and, where scores
are tied, over their doc_ids. No document is ever compared with another and nothing is sorted but
the drawn rows, which are partitioned by range to be ranked.

Null text has no words. A null doc_id is the empty text in the noise and comes after all others in a
tie. Rows that agree in doc_id and score are interchangeable: the cut may fall between them, and each
gets a rank of its own. Other columns are ignored. Without target texts all gains still follow from
the formula. An empty table gives no rows. Texts of any length are worked through in pieces of about
PIECE_BYTES; only one word is ever held as a whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkpulse.llm.shared import partitions, read_table, written
from parkpulse.llm.wordhash import ALNUM, slices, text_buffers

BUCKETS = 10_000
SCALE = 1000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
PIECE_BYTES = 2 << 20
#: Thresholds counted by one job; 15 are four halvings.
CUTS = 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longest second word of a pair whose checksum is combined by table; longer ones are summed anew.
_TABLE_BYTES = 128


def _crc_steps() -> np.ndarray:
    """For each length, what so many zero bytes make of each byte of a CRC-32."""
    byte = np.arange(256, dtype=np.uint32)
    table = byte.copy()
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    steps = np.zeros((_TABLE_BYTES + 2, 4, 256), np.uint32)
    steps[0] = byte[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(steps)):
        steps[n] = (steps[n - 1] >> 8) ^ table[steps[n - 1] & 255]
    return steps


_STEPS = _crc_steps()


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of A followed by B from those of A and of B and the bytes of B (up to _TABLE_BYTES + 1)."""
    out = second.copy()
    for j in range(4):
        out ^= _STEPS[size, j, (first >> np.uint32(8 * j)) & np.uint32(255)]
    return out


class Words:
    """Words of a stretch of text: their CRC-32s and those of each with a space before, by word."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        inside = ALNUM[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[edges] = True
        gap = np.ones(len(data) + 2, bool)
        gap[1:-1] = ~inside
        begins = np.flatnonzero(inside & (edge[:-1] | gap[:-2]))
        ends = np.flatnonzero(inside & (edge[1:] | gap[2:])) + 1
        offsets = np.concatenate([[0], np.cumsum(ends - begins)])
        flat = _LOWER[data[inside]]
        array = pa.Array.from_buffers(
            pa.binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)]
        ).dictionary_encode()
        own = array.dictionary.to_pylist()
        which = array.indices.to_numpy()
        space = zlib.crc32(b" ")
        self.of = np.searchsorted(begins, edges)
        self.own, self.which = own, which
        self.crc = np.array([zlib.crc32(w) for w in own], np.uint32)[which] if own else np.zeros(0, np.uint32)
        self.spaced = np.array([zlib.crc32(w, space) for w in own], np.uint32)[which] if own else self.crc
        self.size = (ends - begins + 1).astype(np.int64)

    def pairs(self) -> np.ndarray:
        """CRC-32 of each word, a space and the word after it, whatever document that is in."""
        if len(self.crc) < 2:
            return np.zeros(0, np.uint32)
        size = self.size[1:]
        long = size > _TABLE_BYTES + 1
        out = joined_crc(self.crc[:-1], self.spaced[1:], np.where(long, 0, size))
        for i in np.flatnonzero(long).tolist():
            out[i] = zlib.crc32(b" " + self.own[self.which[i + 1]], int(self.crc[i]))
        return out


def _stretches(raw: np.ndarray, at: np.ndarray, piece: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first document, documents, bytes, edges, whether the document goes on from the last stretch)."""
    for first, last in slices(at, piece):
        lo, hi = int(at[first]), int(at[last])
        if last - first > 1 or hi - lo <= piece:
            yield first, last - first, raw[lo:hi], at[first : last + 1] - lo, False
            continue
        size, goes_on = piece, False
        while lo < hi:
            data = raw[lo : min(lo + size, hi)]
            if lo + size < hi:
                gaps = np.flatnonzero(~ALNUM[data])
                if not len(gaps):
                    size *= 2
                    continue
                data = data[: gaps[-1] + 1]
            yield first, 1, data, np.array([0, len(data)]), goes_on
            lo, size, goes_on = lo + len(data), piece, True


def bucketed(raw: np.ndarray, at: np.ndarray, piece: int = PIECE_BYTES) -> Iterator[tuple]:
    """(first document, documents, words, buckets of words, word offsets, buckets of pairs, pair offsets)."""
    last = None
    for first, n, data, edges, goes_on in _stretches(raw, at, piece):
        words = Words(data, edges)
        pairs = words.pairs()
        if n == 1:
            of_pairs = np.array([0, len(pairs)])
        else:
            inner = words.of[1:-1]
            across = inner[(inner > 0) & (inner < len(words.crc))] - 1
            keep = np.ones(len(pairs), bool)
            keep[across] = False
            of_pairs = np.concatenate([[0], np.cumsum(keep)])[np.clip(words.of - 1, 0, len(pairs))]
            pairs = pairs[keep]
        if goes_on and last is not None and len(words.crc):
            pairs = np.append(pairs, np.uint32(zlib.crc32(b" " + words.own[words.which[0]], last)))
            of_pairs = np.array([0, len(pairs)])
        if len(words.crc):
            last = int(words.crc[-1])
        elif not goes_on:
            last = None
        yield first, n, np.diff(words.of), words.crc % BUCKETS, words.of, pairs % BUCKETS, of_pairs


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often the features of all texts fall into each bucket. Each task sends one row per bucket."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, singles, _, pairs, _ in bucketed(*text_buffers(batch.column(0))):
                total += np.bincount(singles, minlength=BUCKETS) + np.bincount(pairs, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: scaled log ratio of its smoothed shares in target and source."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in pairs], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of doc_id, text."""

    def run(batches):
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, n, counts, singles, of, pairs, of_pairs in bucketed(*text_buffers(batch.column(1))):
                rows = slice(first, first + n)
                words[rows] += counts
                features[rows] += counts + np.diff(of_pairs)
                for buckets, offsets in ((singles, of), (pairs, of_pairs)):
                    total[rows] += np.diff(np.concatenate([[0], np.cumsum(gain[buckets])])[offsets])
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            columns = [batch.column(0), *map(pa.array, (words, features, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    )


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise that follows from the seed and the doc_id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def lowest_drawn(rows: DataFrame, value: str, wanted: int, cuts: int = CUTS) -> tuple[int, int] | None:
    """(v, n): the highest v such that at least `wanted` rows have `value` >= v, and n rows have more.

    None if fewer rows have a value. Each job counts the rows from `cuts` places on between the bounds
    known so far, so the bounds close in on v by a factor of cuts + 1 a job.
    """
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < wanted:
        return None
    # At least `wanted` rows have low or more; `above` < wanted rows have high + 1 or more.
    high, above = high + 1, 0
    while high - low > 1:
        places = sorted({low + (high - low) * i // (cuts + 1) for i in range(1, cuts + 1)} - {low})
        counts = rows.agg(*[F.count_if(F.col(value) >= p).alias(f"c{i}") for i, p in enumerate(places)]).first()
        for p, c in zip(places, counts, strict=True):
            if c >= wanted:
                low = p
            else:
                high, above = p, c
                break
    return low, above


def drawn(scored: DataFrame, wanted: int) -> Column:
    """Condition on the rows of `scored`: the `wanted` highest by score, ties to the smaller doc_id.
    Rows equal in both to the last one are all let through; ranks tell them apart."""
    score, above = lowest_drawn(scored, "score", wanted)
    tied = scored.where(F.col("score") == score)
    # The smaller doc_id first, null last: as a falling key.
    key = F.bitwise_not(F.col("doc_id"))
    last = lowest_drawn(tied.select(key.alias("key")), "key", wanted - above)
    among = F.lit(True) if last is None else key >= last[0]
    return (F.col("score") > score) | ((F.col("score") == score) & among)


def ranked(rows: DataFrame) -> DataFrame:
    """Add `rank`, 1 for the highest score. Rows are dealt by range, sorted within their range and
    numbered there; the ranges' sizes, one row each, say how many rows come before."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"))
    dealt = written(
        rows.repartitionByRange(partitions(rows.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    )
    # One row per partition.
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    # The id of a row is its partition's number above 33 bits of its place there.
    place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("start") + place + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score of every row of doc_id, text, and the rank of the drawn ones:
    `percent` of the documents with at least `least_words` words, rounded down."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = written(weighted(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"))))
    eligible = scored.where(F.col("n_words") >= least_words)
    wanted = percent * eligible.count() // 100
    columns = ("doc_id", "n_features", "weight", "score")
    none = F.lit(None).cast("bigint").alias("rank")
    if not wanted:
        return scored.select(*columns, none)
    through = F.coalesce((F.col("n_words") >= least_words) & drawn(eligible, wanted), F.lit(False))
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    chosen = ranked(scored.where(through).select(*columns)).select(*columns, rank)
    return chosen.unionByName(scored.where(~through).select(*columns, none))


def op13_target_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH steps AS (
    SELECT list(list_reduce(list_prepend(n, range(8)),
                lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc
    FROM range(256) AS r(n)
), texts AS (
    SELECT 'd' AS side, row_number() OVER () AS id, doc_id, text FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), split AS (
    SELECT side, id, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
    SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
    FROM split
), each AS (
    SELECT side, id, f, count(*) AS n FROM features GROUP BY ALL
), hashed AS (
    SELECT f, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(f)) + 1, 2),
            lambda i: ('0x' || hex(encode(f))[i:i + 1])::BIGINT)),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM each), steps
), counts AS (
    SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t
    FROM each JOIN hashed USING (f) GROUP BY bucket
), sums AS (
    SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts
), gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000)
        / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
    FROM counts, sums
), weights AS (
    SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
    FROM each JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
    SELECT id, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
            / 4294967296)))::BIGINT AS score
    FROM split LEFT JOIN weights USING (id) WHERE side = 'd'
), placed AS (
    SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n
    FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS "rank"
FROM scored LEFT JOIN placed USING (id)
"""
