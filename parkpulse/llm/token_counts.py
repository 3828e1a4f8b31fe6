"""Token counts of whole texts by a map-side lookup in two tiers; no pre-token is ever shuffled.

Texts are cut into runs at places where the tokenizer's own splitter always cuts, whatever stands
around them, so the tokens of a text are those of its runs. The first tier is a compact table of the
lengths of frequent runs, broadcast to every task; the second is a cache in each Python worker, which
asks the tokenizer only for runs it has not met. Both hold the bytes of a run, so nothing rests on
hashes, and what is in either tier changes speed only, never a count.

The table is learnt from all texts: each task keeps a summary of heavy hitters (bounded, after Misra
and Gries), and Spark adds up the summaries. Its size is bounded by FREQUENT runs of at most
FREQUENT_BYTES bytes.

Null text counts as empty: no bytes, no tokens. Rows keep their doc_id as it is, null, repeated or
not; other columns are ignored. An empty table gives no rows. A text of any length is worked through
in pieces of about PIECE_BYTES; only a single run (such as one endless word) is held as a whole.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkpulse.llm.shared import read_table
from parkpulse.llm.wordhash import slices, text_buffers

FREQUENT = 1 << 16
FREQUENT_BYTES = 32
#: Counters of a task's summary of frequent runs.
COUNTERS = 1 << 13
#: Runs remembered by a worker.
REMEMBER = 1 << 18
PIECE_BYTES = 4 << 20
LIMIT = 512

# Classes of bytes. OTHER holds whatever the splitter may treat in ways not seen here: bytes of
# non-ASCII characters, control characters, and the apostrophe, which may begin a contraction.
_OTHER, _SPACE, _LETTER, _DIGIT, _MARK = range(5)
_CLASS = np.zeros(256, np.int8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x21, 0x7F)]] = _MARK
_CLASS[[*range(0x30, 0x3A)]] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x27] = _OTHER


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions inside `data` at which a run always begins, if the text goes on on both sides.

    The splitter takes an optional space with a run of letters, digits or other marks, or a
    contraction; of white space it leaves the last character to what follows. So it always cuts

    * before white space that follows a visible ASCII character,
    * before the one white-space character in front of a visible ASCII character, and after it
      unless it is the plain space,
    * between letters, digits and marks.
    """
    kind = _CLASS[data]
    now, before = kind[1:], kind[:-1]
    seen, seen_before = now > _SPACE, before > _SPACE
    space, space_before = now == _SPACE, before == _SPACE
    cut = (seen_before & space) | (seen & seen_before & (now != before))
    cut |= seen & space_before & (data[:-1] != 0x20)
    cut[:-1] |= space[:-1] & seen[1:]
    return np.flatnonzero(cut) + 1


def runs(data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(runs as binary, number of the first run of each document); edges are the documents' offsets."""
    inside = np.zeros(len(data) + 1, bool)
    inside[cuts(data)] = True
    inside[edges] = True
    at = np.flatnonzero(inside)
    at = at if len(at) > 1 else np.zeros(1, np.int64)
    offsets = pa.py_buffer(at.astype(np.int32))
    array = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, pa.py_buffer(data)])
    return array, np.searchsorted(at, edges)


def blocks(raw: np.ndarray, at: np.ndarray, piece: int = PIECE_BYTES):
    """(first document, documents, bytes, edges): groups of documents, or one piece of a long one."""
    for first, last in slices(at, piece):
        lo, hi = int(at[first]), int(at[last])
        if last - first > 1 or hi - lo <= piece:
            yield first, last - first, raw[lo:hi], at[first : last + 1] - lo
            continue
        size = piece
        while lo < hi:
            data = raw[lo : min(lo + size, hi)]
            if lo + size < hi:
                places = cuts(data)
                # The last place may rest on a character cut in half by the window.
                places = places[places < len(data) - 8]
                if not len(places):
                    size *= 2
                    continue
                data = data[: places[-1]]
            yield first, 1, data, np.array([0, len(data)])
            lo, size = lo + len(data), piece


class Frequent:
    """The first tier: frequent runs and their lengths, looked up in Arrow's hash table."""

    def __init__(self, tokens: pa.Array, lengths: np.ndarray):
        self.tokens, self.lengths = tokens, lengths.astype(np.int64)

    def lookup(self, values: pa.Array) -> np.ndarray:
        """Lengths, -1 where a run is not in the table."""
        found = pc.index_in(values, value_set=self.tokens)
        place = found.fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(place >= 0, self.lengths[place], -1) if len(self.lengths) else np.full(len(values), -1)


@lru_cache(maxsize=2)
def _counter(path: str) -> RunLengths:
    """One per worker, so that its cache outlives a task."""
    return RunLengths(path)


class RunLengths:
    """The second tier: lengths of runs by the tokenizer, remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, values: list[bytes]) -> np.ndarray:
        """Of two generations of memory the older is dropped, so runs in use stay."""
        if len(self.known) > REMEMBER // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        lengths = [n if (n := known.get(v, -1)) >= 0 else older.get(v, -1) for v in values]
        new = [i for i, n in enumerate(lengths) if n < 0]
        for i, n in zip(new, self.encoded([values[i].decode() for i in new]) if new else (), strict=True):
            lengths[i] = n
        known.update((v, n) for v, n in zip(values, lengths, strict=True) if len(v) <= 256)
        return np.array(lengths, np.int64)

    def counts(self, data: np.ndarray, edges: np.ndarray, frequent: Frequent) -> np.ndarray:
        """Tokens of each document between `edges`, none of which may hold a special token's text."""
        array, first = runs(data, edges)
        if not len(array):
            return np.zeros(len(edges) - 1, np.int64)
        coded = array.dictionary_encode()
        lengths = frequent.lookup(coded.dictionary)
        missing = np.flatnonzero(lengths < 0)
        if len(missing):
            lengths[missing] = self(coded.dictionary.take(pa.array(missing)).to_pylist())
        total = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy()])])
        return np.diff(total[first])


def frequent_runs(docs: DataFrame, limit: int = FREQUENT) -> list[bytes]:
    """The runs counted most in all texts, `limit` at most, of at most FREQUENT_BYTES bytes.

    A task sends no more than COUNTERS rows whatever it reads: when its summary is full it lowers all
    counters by the one in the middle and drops what falls to nothing.
    """

    def summary(batches):
        kept: Counter = Counter()
        for batch in batches:
            raw, at = text_buffers(batch.column(0))
            for _, _, data, edges in blocks(raw, at):
                array, _ = runs(data, edges)
                counted = array.filter(pc.less_equal(pc.binary_length(array), FREQUENT_BYTES)).value_counts()
                often = counted.filter(pc.greater(counted.field(1), 1))
                kept.update(dict(zip(often.field(0).to_pylist(), often.field(1).to_pylist(), strict=True)))
                if len(kept) > COUNTERS:
                    middle = sorted(kept.values(), reverse=True)[COUNTERS // 2]
                    kept = Counter({k: n - middle for k, n in kept.items() if n > middle})
        top = kept.most_common(COUNTERS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["run", "n"]
        )

    rows = (
        docs.select("text")
        .mapInArrow(summary, "run binary, n bigint")
        .groupBy("run")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "run")
        .limit(limit)
        .collect()
    )
    return [bytes(r.run) for r in rows]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of doc_id, text."""
    spark = docs.sparkSession
    often = frequent_runs(docs, limit)
    table = (pa.array(often, pa.binary()), np.array(RunLengths(tokenizer_path)(often), np.int64).astype(np.uint8))
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        frequent, lengths = Frequent(*shared.value), _counter(tokenizer_path)
        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            special = np.zeros(batch.num_rows, bool)
            text = raw[at[0] : at[-1]].tobytes()
            for mark in lengths.special:
                place = text.find(mark)
                while place >= 0:
                    row = int(np.searchsorted(at, at[0] + place, "right")) - 1
                    special[row] = True
                    # On to the next document: this one is encoded as a whole.
                    place = text.find(mark, int(at[row + 1] - at[0]))
            for row in np.flatnonzero(special).tolist():
                tokens[row] = lengths.encoded([raw[at[row] : at[row + 1]].tobytes().decode()])[0]
            for first, n, data, edges in blocks(raw, at):
                tokens[first : first + n] += np.where(special[first : first + n], 0, lengths.counts(data, edges, frequent))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint"
    )


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
