"""Scores of documents by context-tree weighting (`context_tree`) and by smoothed word counts.

Documents are handled in blocks. A block asks for its distinct words and 4-grams, and says how often
its training documents have them; questions are packed into one row per block and shard. Shards are
dealt out by hash of the word, or of the two bytes before a symbol. A shard adds up the counts of
all blocks and answers each block, which then scores its texts from the answers alone.

So what moves is the texts once, and the distinct words and 4-grams of each block four times; a word
that fills a third of the corpus is one entry per block. Nothing that grows with the corpus is
broadcast or sent to the driver: the sums of context depths 0 and 1 have at most 65,536 rows.

Texts are seen with A-Z in lower case. Each has one end token (base score) and one end byte (model),
so null or empty text has one token. Words are told apart by 64-bit hashes. Rows are scored one by
one, whatever rows repeat; other columns are ignored; with no training document the base score is
that of one unseen token each and the model gives every bit a half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkpulse.llm.context_tree import Shard, Top, four_grams
from parkpulse.llm.language_id import held_out
from parkpulse.llm.shared import partitions, read_table, written
from parkpulse.llm.wordhash import NOT_SPACE, counted, distinct, mix, slices, text_buffers, words

BLOCK_ROWS = 2048
#: Largest direct table of 4-gram answers in a block; beyond it they are looked up by bisection.
DIRECT = 1 << 24

_END = np.array([0x00E0D00E0D00E0D0], np.uint64)
_WORDS, _GRAMS = 0, 1
_ASKED = "kind int, shard int, block bigint, keys binary, counts binary"
_ANSWER = "block bigint, kind int, keys binary, answers binary"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def file_blocks(rows: int = BLOCK_ROWS) -> Column:
    """Blocks of neighbouring rows of a Parquet source: known without moving a text."""
    row = F.floor(F.col("_metadata.row_index") / rows)
    return F.xxhash64(F.col("_metadata.file_path"), row)


class _Block:
    """What the documents of one block ask for."""

    def __init__(self):
        self.words, self.grams, self.docs, self.trained = [], [], 0, 0

    def add(self, raw: np.ndarray, at: np.ndarray, train: np.ndarray) -> None:
        for first, last in slices(at):
            mine, use = at[first : last + 1], train[first:last]
            hashes, _, _, of = words(raw, mine, NOT_SPACE)
            self.words.append(counted(hashes, np.repeat(use, np.diff(of)).astype(np.int64)))
            grams, offsets = four_grams(_LOWER[raw[mine[0] : mine[-1]]], mine)
            learnt = np.repeat(use, np.diff(offsets))
            self.grams.append(counted(grams[learnt]))
            other = distinct(grams[~learnt])
            self.grams.append((other, np.zeros(len(other), np.int64)))
            if len(self.grams) > 32:
                self._fold()
        self.docs += len(train)
        self.trained += int(train.sum())

    def _fold(self) -> None:
        self.words = [counted(*(np.concatenate(x) for x in zip(*self.words, strict=True)))]
        self.grams = [counted(*(np.concatenate(x) for x in zip(*self.grams, strict=True)))]

    def rows(self, block: int, shards: int) -> list[tuple]:
        self.words.append((_END, np.array([self.trained])))
        self._fold()
        out = []
        for kind, (keys, counts) in ((_WORDS, self.words[0]), (_GRAMS, self.grams[0])):
            spread = keys if kind == _WORDS else (keys >> np.uint32(8)) & np.uint32(0xFFFF)
            shard = (mix(spread.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            keys, counts, shard = keys[order], counts[order], shard[order]
            at = np.flatnonzero(np.diff(shard, prepend=-1))
            for a, z in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
                out.append((kind, int(shard[a]), block, keys[a:z].tobytes(), counts[a:z].astype("<u4").tobytes()))
        return out


def _asked(docs: DataFrame, shards: int) -> DataFrame:
    names = ["kind", "shard", "block", "keys", "counts"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def rows(block: _Block, number: int) -> pa.RecordBatch:
        columns = zip(*block.rows(number, shards), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches):
        block, number = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, at = text_buffers(batch.column(3))
            train = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, z in zip(cuts, cuts[1:]):
                if number != numbers[a]:
                    if block:
                        yield rows(block, number)
                    block, number = _Block(), int(numbers[a])
                block.add(raw, at[a : z + 1], train[a:z])
        if block:
            yield rows(block, number)

    return docs.mapInArrow(run, _ASKED)


class _Questions:
    """The rows of one kind in a partition, and what they come to together."""

    def __init__(self, batches, key_type):
        self.blocks, keys, counts = [], [], []
        for batch in batches:
            self.blocks += batch.column(2).to_pylist()
            keys += [np.frombuffer(x, key_type) for x in batch.column(3).to_pylist()]
            counts += [np.frombuffer(x, "<u4") for x in batch.column(4).to_pylist()]
        self.raw = keys
        self.cuts = np.cumsum([len(k) for k in keys])
        joined = np.concatenate(keys) if keys else np.zeros(0, key_type)
        self.keys, self.of = np.unique(joined, return_inverse=True)
        weights = np.concatenate(counts).astype(np.float64) if counts else np.zeros(0)
        self.counts = np.bincount(self.of, weights, len(self.keys)).astype(np.int64)

    def answer(self, kind: int, values: np.ndarray):
        for block, keys, answers in zip(self.blocks, self.raw, np.split(values[self.of], self.cuts)[: len(self.raw)], strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([kind], pa.int32()), pa.array([keys.tobytes()]), pa.array([answers.tobytes()])],
                ["block", "kind", "keys", "answers"],
            )


def _word_answers(asked: DataFrame, shards: int) -> DataFrame:
    """Counts of the words of each block; and, with a null block, how many words a shard counted."""

    def run(batches):
        found = _Questions(batches, np.uint64)
        totals = np.array([found.counts.sum(), (found.counts > 0).sum()], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.array([_WORDS], pa.int32()), pa.array([b""]), pa.array([totals.tobytes()])],
            ["block", "kind", "keys", "answers"],
        )
        yield from found.answer(_WORDS, found.counts)

    return asked.where(F.col("kind") == _WORDS).repartition(shards, "shard").mapInArrow(run, _ANSWER)


def _top(asked: DataFrame, shards: int) -> Top:
    """Depths 0 and 1 of the tree; at most 65,536 rows reach the driver."""

    def run(batches):
        found = _Questions(batches, np.uint32)
        place, zeros, ones, deeper = Shard(found.keys, found.counts).upward()
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(zeros), pa.array(ones), pa.array(deeper)], ["place", "zeros", "ones", "deeper"]
        )

    sums = (
        asked.where(F.col("kind") == _GRAMS).repartition(shards, "shard")
        .mapInArrow(run, "place bigint, zeros double, ones double, deeper double")
        .groupBy("place").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("deeper").alias("deeper"))
        .orderBy("place").toArrow()
    )
    return Top(*(sums[n].to_numpy() for n in ("place", "zeros", "ones", "deeper")))


def _gram_answers(asked: DataFrame, top: Top, shards: int) -> DataFrame:
    sent = asked.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        found = _Questions(batches, np.uint32)
        yield from found.answer(_GRAMS, Shard(found.keys, found.counts).log10_probabilities(sent.value))

    return asked.where(F.col("kind") == _GRAMS).repartition(shards, "shard").mapInArrow(run, _ANSWER)


class _Lookup:
    """Answers by 4-gram: a table over the first and the last two bytes that occur, if that fits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        high, low = distinct(keys >> np.uint32(16)), distinct(keys & np.uint32(0xFFFF))
        self.table = None
        if len(high) * len(low) <= DIRECT:
            self.high, self.low = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
            self.high[high], self.low[low] = np.arange(len(high)) * len(low), np.arange(len(low))
            self.table = np.zeros(len(high) * len(low))
            self.table[self.high[keys >> np.uint32(16)] + self.low[keys & np.uint32(0xFFFF)]] = values

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        if self.table is None:
            return self.values[np.searchsorted(self.keys, grams)]
        return self.table[self.high[grams >> np.uint32(16)] + self.low[grams & np.uint32(0xFFFF)]]


def _score_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
    out = {n: [] for n in ("n_tokens", "n_known", "seen_log10", "score")}
    texts = texts.combine_chunks()
    found = {}
    for kind, key_type, value_type in ((_WORDS, np.uint64, np.int64), (_GRAMS, np.uint32, np.float64)):
        rows = answers.filter(pa.compute.equal(answers["kind"], kind))
        keys = np.concatenate([np.frombuffer(x, key_type) for x in rows["keys"].to_pylist()] or [np.zeros(0, key_type)])
        values = np.concatenate([np.frombuffer(x, value_type) for x in rows["answers"].to_pylist()] or [np.zeros(0, value_type)])
        found[kind] = keys, values
    order = np.argsort(found[_WORDS][0])
    word_keys, word_counts = found[_WORDS][0][order], found[_WORDS][1][order]
    logs, known = np.log10(word_counts + 1.0), word_counts > 0
    at_end = int(np.searchsorted(word_keys, _END[0])) if len(word_keys) else 0
    lookup = _Lookup(*found[_GRAMS])
    for chunk in texts["text"].chunks:
        raw, at = text_buffers(chunk)
        for first, last in slices(at):
            mine = at[first : last + 1]
            hashes, _, _, of = words(raw, mine, NOT_SPACE)
            places = np.searchsorted(word_keys, hashes)
            sums = np.concatenate([[0.0], np.cumsum(logs[places])])
            n_known = np.concatenate([[0], np.cumsum(known[places])])
            out["n_tokens"].append(np.diff(of) + 1)
            out["n_known"].append(np.diff(n_known[of]) + int(known[at_end]))
            out["seen_log10"].append(np.diff(sums[of]) + logs[at_end])
            grams, offsets = four_grams(_LOWER[raw[mine[0] : mine[-1]]], mine)
            out["score"].append(np.add.reduceat(lookup(grams), offsets[:-1]))
    columns = {n: pa.array(np.concatenate(x)) for n, x in out.items()}
    return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held_out"], **columns})


def score(docs: DataFrame, block: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document.

    Learns from documents that are not held out. `block` deals documents into blocks that fit a task;
    by default they are dealt by doc_id, which moves the texts once more.
    """
    shards = partitions(docs.sparkSession)
    rows = docs.select(
        F.coalesce(block if block is not None else F.pmod(F.xxhash64("doc_id"), F.lit(4 * shards)), F.lit(0)).cast("bigint").alias("block"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(held_out(docs["doc_id"], 7), F.lit(False)).alias("held_out"),
        "text",
    )
    by_block = rows if block is not None else rows.repartition(shards, "block").sortWithinPartitions("block")
    asked = written(_asked(by_block, shards))
    counts = written(_word_answers(asked, shards))
    totals = np.zeros(2, np.int64)
    # One row per shard.
    for row in counts.where("block IS NULL").select("answers").toArrow()["answers"].to_pylist():
        totals += np.frombuffer(row, np.int64)
    n, v = int(totals[0]), int(totals[1])
    answers = counts.where("block IS NOT NULL").union(_gram_answers(asked, _top(asked, shards), shards))
    scored = (
        rows.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            _score_block,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, seen_log10 double, score double",
        )
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("seen_log10") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        "score",
    )


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, file_blocks())
