"""Token ids as Parquet list columns, written in doc_id order and read back selectively.

One shuffle: texts are range-partitioned by doc_id (the ids are made after it, so nothing larger
moves) and each task encodes its sorted range and writes one file.

Layout of a file: part, doc_id, begin (ids before the document within its file), n_tokens,
ids list<int32>. Row groups and pages are held to set sizes and pages carry column indexes, so that
a read by doc_id or of the counts alone touches few pages. Ids are dictionary-encoded while a page's
dictionary is small, else delta-packed (writer version 2).

Null text counts as empty; each document ends with END. Equal doc_ids stand in order of their text;
a null doc_id comes first. An empty table gives files without rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parkpulse.llm.shared import partitions, read_table, shared_folder, written
from parkpulse.llm.wordhash import NOT_SPACE, slices, text_buffers

END = 1
BLOCK_BYTES = 4 << 20
#: Distinct runs remembered by a worker between blocks.
REMEMBER = 500_000
#: New runs that are encoded as one text.
JOINED = 2000

LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}
_SCHEMA = "part int, doc_id bigint, begin bigint, n_tokens bigint, ids array<int>"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """One per worker, so that what it remembers outlives a task."""
    return WordEncoder(_tokenizer(path))


class WordEncoder:
    """Encodes blocks of texts, each distinct run of bytes once.

    Runs begin with ASCII white space, and between an ASCII letter or digit and one of the marks in
    MARKS. For tokenizers that drop white space, take A-Z as a-z, split between letters or digits and
    such marks, and whose normaliser joins nothing across these places: then the ids of a text are
    those of its runs in turn. Runs are found and told apart by their bytes, in Arrow's hash table. A
    block with the beginning of a special token is encoded text by text instead.

    New runs are encoded many at a time, with MARKER as a word after each; one by one if a run holds it,
    or if the tokenizer has no id for it alone. Of too many runs those that stood in one block only are
    forgotten.
    """

    SPECIAL = b"<|"
    MARKS = b".,!?;:%&*#$"
    MARKER = "\x01"
    _WORD, _MARK, _SPACE = 1, 2, 4

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.kind = np.zeros(256, np.int8)
        self.kind[[*range(48, 58), *range(65, 91), *range(97, 123)]] = self._WORD
        self.kind[list(self.MARKS)] = self._MARK
        self.kind[~NOT_SPACE] = self._SPACE
        # A-Z as a-z, all white space as one.
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.fold[~NOT_SPACE] = 0x20
        #: The id of MARKER where it stands as a word of its own, if no other text has it.
        alone, other, beside = (tokenizer.encode(x, add_special_tokens=False).ids for x in (self.MARKER, "\x02", f"a {self.MARKER} ,"))
        apart = [tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", ",")]
        self.marker = alone[0] if len(alone) == 1 and alone != other and beside == [*apart[0], *alone, *apart[1]] else None
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        #: Blocks in which each known run stood.
        self.blocks = np.zeros(0, np.int32)

    def _forget(self) -> None:
        keep = self.blocks > 1
        if 2 * np.count_nonzero(keep) > REMEMBER:
            keep[:] = False
        self.known = dict(zip(compress(self.known, keep.tolist()), range(len(keep))))
        starts, self.sizes, self.blocks = self.starts[keep], self.sizes[keep], np.ones(len(self.known), np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = self.flat[np.arange(int(self.sizes.sum())) + np.repeat(starts - self.starts, self.sizes)]

    def _encoded(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by run) of new runs."""
        mark = self.MARKER.encode()
        texts = [b" ".join(x for run in runs[i : i + JOINED] for x in (run, mark)) for i in range(0, len(runs), JOINED)]
        if self.marker is None or sum(t.count(mark) for t in texts) != len(runs):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        flat = np.concatenate([np.array(x, np.int32) for x in ids])
        cuts = np.flatnonzero(flat == self.marker)
        return flat[flat != self.marker], np.diff(cuts, prepend=-1) - 1

    def _learn(self, runs: list[bytes]) -> None:
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs)), strict=True))
        flat, sizes = self._encoded(runs)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.blocks = np.concatenate([self.blocks, np.zeros(len(runs), np.int32)])

    def _runs(self, bytes_: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(runs, number of the first run of each document)."""
        kind = self.kind[bytes_]
        now, before = kind[1:], kind[:-1]
        begins = np.zeros(len(bytes_) + 1, bool)
        begins[1:-1] = (now + before == self._WORD + self._MARK) & (now != before) & (now > 0) & (before > 0)
        begins[1:-1] |= (now == self._SPACE) & (before != self._SPACE)
        begins[edges] = True
        at = np.flatnonzero(begins)
        buffers = [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(self.fold[bytes_])]
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, buffers), np.searchsorted(at, edges)

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by document) of the documents between `at` in `raw`, each with its END."""
        bytes_ = raw[at[0] : at[-1]]
        if self.SPECIAL in bytes_.tobytes():
            return self._whole(raw, at)
        if len(self.known) > REMEMBER:
            self._forget()
        array, first = self._runs(bytes_, at - at[0])
        coded = array.dictionary_encode()
        own = coded.dictionary.to_pylist()
        new = [run for run in own if run not in self.known]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        self.blocks[place] += 1
        which = place[coded.indices.to_numpy()]
        sizes = self.sizes[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.starts[which] - total[:-1], sizes)]
        offsets = total[first]
        return np.insert(ids, offsets[1:], END), offsets + np.arange(len(offsets))

    def _whole(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[a:z].tobytes().decode() for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)]
        ids = [[*x.ids, END] for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, files: int | None = None) -> DataFrame:
    """Write the token files into `folder` and return them as read from there."""
    spark = docs.sparkSession

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            for first, last in slices(at, BLOCK_BYTES):
                ids, offsets = encoder.ids(raw, at[first : last + 1])
                n = last - first
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), batch.column(0).slice(first, n),
                     pa.array(total + offsets[:-1]), pa.array(np.diff(offsets)), lists],
                    ["part", "doc_id", "begin", "n_tokens", "ids"],
                )
                total += int(offsets[-1])

    (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange(files or partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, _SCHEMA)
        .write.options(**LAYOUT)
        .parquet(folder)
    )
    return spark.read.schema(_SCHEMA).parquet(folder)


def document_starts(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of written files; the counts alone are read to place the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # Written, so that Spark knows how small it is and need not shuffle the ids to join it.
    parts = written(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return files.join(parts, "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids")


def checksums(placed: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat = lists.values.to_numpy().astype("<i4", copy=False)
            at = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark)
    files = write_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return checksums(document_starts(files))
