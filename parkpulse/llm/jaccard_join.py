"""N-gram Jaccard join with adaptive multi-match prefixes; connected components of the links.

A document's set is its distinct 5-word shingles; with fewer words, the whole sequence is the one
shingle. Two documents link when 100 * |intersection| >= 80 * |union|.

1. Equal sets form a class, known by a 128-bit digest; from here on only its smallest doc_id, the
   representative, counts. Copies cost nothing more, however many they are.
2. A count sketch of fixed size estimates how many documents hold each shingle. All sets are ordered
   by (estimate, hash), rare first.
3. If two sets of sizes x and y link, they share at least s = ceil(4(x + y)/9) shingles, and so at
   least l of the first x - s + l of the one and y - s + l of the other, for any l. A document picks
   its l by the estimated number of candidates in its prefix: the dearer, the longer the prefix and
   the more shared shingles are asked for. A pair is held to the smaller l of its two documents, and
   to no more than s: short sets that link may share fewer shingles than frequent ones ask for.
4. Postings of a shingle meet in one shard. First every document is paired only with the least
   edited one of the posting (the one in whose order the shingle comes first): one pair per posting,
   not all pairs. These pairs are verified on the whole sets, and the links joined into components.
5. Then pairs between different components that pass (3) and were not yet verified are verified too.
   Pairs inside a component cannot change it. So no link between components is lost. A pair is not
   even counted if the bitmaps of what each document could share show fewer than l shingles.

A shingle that very many documents hold in their prefix is cut into blocks: each document goes to
every pair of blocks that includes its own, so that no task holds a whole posting (BLOCK).

Null or blank text has an empty set and links with nothing. Repeated rows share the result. Where
different texts bear one doc_id, each row is a document of its own: it links by its own text, and its
component is named by the smallest doc_id reached from that text. A null doc_id keeps a null component
and links with nothing. Other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkpulse.llm.graph import components
from parkpulse.llm.shared import arrow_batches, partitions, read_table, written
from parkpulse.llm.wordhash import NOT_SPACE, counted, distinct, mix, rolling, slices, text_buffers, words

N = 5
#: Counters of the sketch (a power of two); one byte each is sent to the tasks.
COUNTERS = 1 << 22
SEGMENT = 1 << 16
#: Estimated documents of a shingle above which its posting is cut into blocks of so many.
BLOCK = 20_000
#: Texts, and pairs with their sets, that a task holds at once.
TEXT_ROWS = 1000
PAIR_ROWS = 200
MOST_MATCHES = 12

_ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("l", "<i2"), ("part", "<i2")])
#: An entry with its component and bitmaps of the keys of its document's entries: of all, and of those
#: that count against a document of the same size or a larger one; `extra`: such entries less bits.
BITMAP = 8
_ENTRY_C = np.dtype(
    [*_ENTRY.descr, ("comp", "<i8"), ("bits", "<u8", (BITMAP,)), ("near", "<u8", (BITMAP,)), ("extra", "<i4")]
)
_PAIRS = "a bigint, b bigint, l int, shared int"


def shingle_sets(batch) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """The ids and the sorted distinct shingle hashes of (doc_id, text), a slice at a time."""
    raw, at = text_buffers(batch.column(1))
    for first, last in slices(at):
        hashes, _, _, of = words(raw, at[first : last + 1], NOT_SPACE)
        grams = rolling(hashes, N)
        sets = [
            distinct(grams[a : z - N + 1]) if z - a >= N else rolling(hashes[a:z], z - a) if z > a else hashes[:0]
            for a, z in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)
        ]
        yield batch.column(0).slice(first, last - first), sets


def _first_pass(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: doc_id, n_shingles, digest; and segment, counts of the sketch."""

    def run(batches):
        names = ["doc_id", "n_shingles", "digest", "segment", "counts"]
        sketch = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for ids, sets in shingle_sets(batch):
                at, n = counted((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int32))
                sketch[at] += n.astype(np.uint32)
                rows = len(sets)
                digests = [hashlib.blake2b(s.data, digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                     pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        for k, part in enumerate(sketch.reshape(-1, SEGMENT)):
            at = np.flatnonzero(part)
            if not len(at):
                continue
            small = np.minimum(part, 0xFFFF).astype("<u2")
            if 4 * len(at) < SEGMENT:
                counts = b"s" + at.astype("<u2").tobytes() + small[at].tobytes()
            else:
                counts = b"d" + small.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([k], pa.int32()), pa.array([counts], pa.binary())], names)

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, segment int, counts binary")


def _levels(counts: DataFrame) -> np.ndarray:
    """The summed sketch as half powers of two, one byte per counter; as large for any input."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = sums.setdefault(k, np.zeros(SEGMENT, np.int64))
                values = np.frombuffer(data, "<u2", offset=1)
                if data[:1] == b"s":
                    half = len(values) // 2
                    total[values[:half]] += values[half:]
                else:
                    total += values
        levels = [np.ceil(2 * np.log2(np.maximum(t, 1))).astype(np.uint8).tobytes() for t in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["segment", "levels"])

    out = np.zeros((COUNTERS // SEGMENT, SEGMENT), np.uint8)
    rows = counts.repartition("segment").mapInArrow(run, "segment int, levels binary").toArrow()
    for k, data in zip(rows["segment"].to_pylist(), rows["levels"].to_pylist(), strict=True):
        out[k] = np.frombuffer(data, np.uint8)
    return out.reshape(-1)


def matches_asked(estimates: np.ndarray, base: float) -> int:
    """How many shared shingles a document asks for, by the documents its prefix would meet."""
    cost = float(np.maximum(estimates - base, 0).sum())
    return min(MOST_MATCHES, 1 + int(np.log2(1 + cost / 200)))


@lru_cache(maxsize=1)
def _scale() -> np.ndarray:
    return 2.0 ** (np.arange(256) / 2)


def _prefix_entries(doc: int, shingles: np.ndarray, levels: np.ndarray, base: float) -> np.ndarray:
    n = len(shingles)
    level = levels[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
    reach = min(n, n - -(-4 * n // 5) + MOST_MATCHES)
    # Rare first. Only the prefix needs its order: equal levels are already in order of hash.
    order = np.argsort(level, kind="stable")[:reach]
    counts = _scale()[level[order]]
    plain = n - -(-4 * n // 5) + 1
    asked = matches_asked(counts[:plain], base)
    length = min(n, plain + asked - 1)
    order, counts = order[:length], counts[:length]
    blocks = np.minimum(np.ceil(counts / BLOCK), 100).astype(np.int64)
    out = np.empty(length, _ENTRY)
    out["key"], out["doc"], out["n"], out["pos"], out["l"], out["part"] = shingles[order], doc, n, np.arange(length), asked, 0
    if (blocks > 1).any():
        more = [out[blocks <= 1]]
        for i in np.flatnonzero(blocks > 1).tolist():
            b = int(blocks[i])
            own = int(mix(np.array([doc], np.int64).view(np.uint64))[0] % np.uint64(b))
            copies = np.repeat(out[i : i + 1], b)
            low, high = np.minimum(own, np.arange(b)), np.maximum(own, np.arange(b))
            copies["key"] = mix(copies["key"] + ((low * b + high + 1).astype(np.uint64) << np.uint64(20)))
            more.append(copies)
        out = np.concatenate(more)
    return out


def _sharded(entries: np.ndarray, shards: int) -> pa.RecordBatch:
    shard = (mix(entries["key"]) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    entries, shard = entries[order], shard[order]
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    cuts = np.append(at, len(entries))
    data = [entries[a:z].tobytes() for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[at], pa.int32()), pa.array(data, pa.binary())], ["shard", "entries"])


def _prefixes(docs: DataFrame, levels: np.ndarray, shards: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    base = float(np.median(2.0 ** (levels[levels > 0] / 2))) if (levels > 0).any() else 1.0

    def run(batches):
        levels = sent.value
        found, held = [], 0
        for batch in batches:
            for ids, sets in shingle_sets(batch):
                found += [_prefix_entries(d, s, levels, base) for d, s in zip(ids.to_pylist(), sets, strict=True) if len(s)]
                held += sum(map(len, sets))
                if held > 1_000_000:
                    yield _sharded(np.concatenate(found), shards)
                    found, held = [], 0
        if found:
            yield _sharded(np.concatenate(found), shards)

    return docs.mapInArrow(run, "shard int, entries binary")


def _runs(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, lengths) of equal keys."""
    key = entries["key"]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return begins, np.diff(np.append(begins, len(key)))


def _passing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of entries of one key count as a shared prefix shingle, and the l of each pair."""
    nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
    least = -(-4 * (nx + ny) // 9)
    asked = np.minimum(np.minimum(x["l"], y["l"]), least)
    fine = (least <= np.minimum(nx, ny)) & (x["doc"] != y["doc"])
    fine &= (x["pos"] <= nx - least + asked - 1) & (y["pos"] <= ny - least + asked - 1)
    return fine, asked


def _pair_batch(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, asked = (np.concatenate(x) for x in zip(*pairs, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b, asked = a[order], b[order], asked[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(a)))
    return pa.RecordBatch.from_arrays(
        [pa.array(a[at]), pa.array(b[at]), pa.array(asked[at].astype(np.int32)), pa.array(n.astype(np.int32))],
        ["a", "b", "l", "shared"],
    )


def _gathered(batches, kind: np.dtype, column: int) -> np.ndarray:
    data = [np.frombuffer(x, kind) for batch in batches for x in batch.column(column).to_pylist()]
    return np.concatenate(data) if data else np.zeros(0, kind)


def _pivot_pairs(sharded: DataFrame, shards: int) -> DataFrame:
    """Pairs with the least edited document of each posting; and the postings of two or more."""

    def run(batches):
        entries = _gathered(batches, _ENTRY, 1)
        entries = entries[np.lexsort((entries["doc"], entries["pos"], entries["key"]))]
        begins, lengths = _runs(entries)
        shared = np.repeat(lengths, lengths) > 1
        pivot = entries[np.repeat(begins, lengths)][shared]
        entries = entries[shared]
        fine, asked = _passing(pivot, entries)
        pairs = _pair_batch([(pivot["doc"][fine], entries["doc"][fine], asked[fine])])
        yield pa.RecordBatch.from_arrays([*pairs.columns, pa.nulls(len(pairs), pa.binary())], [*pairs.schema.names, "entries"])
        for at in range(0, len(entries), 50_000):
            nothing = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())]
            data = pa.array([entries[at : at + 50_000].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([*nothing, data], [*pairs.schema.names, "entries"])

    return sharded.repartition(shards, "shard").mapInArrow(run, _PAIRS + ", entries binary")


def _unpacked(postings: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                e = np.frombuffer(data, _ENTRY)
                columns = [e["key"].view(np.int64), e["doc"], e["n"], e["pos"], e["l"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "doc", "n", "pos", "l"]
                )

    return postings.mapInArrow(run, "key bigint, doc bigint, n int, pos int, l smallint")


def _with_bitmaps(entries: np.ndarray) -> np.ndarray:
    """Fill in the bitmaps; all entries of a document must be there."""
    entries = entries[np.argsort(entries["doc"], kind="stable")]
    begins = np.flatnonzero(np.concatenate([[True], entries["doc"][1:] != entries["doc"][:-1]]))
    sizes = np.diff(np.append(begins, len(entries)))
    at = (mix(entries["key"] ^ np.uint64(0x5BF03635)) % np.uint64(64 * BITMAP)).astype(np.int64)
    one = np.zeros((len(entries), BITMAP), np.uint64)
    one[np.arange(len(entries)), at >> 6] = np.uint64(1) << (at & 63).astype(np.uint64)
    entries["bits"] = np.repeat(np.bitwise_or.reduceat(one, begins, axis=0), sizes, axis=0)
    n = entries["n"].astype(np.int64)
    counts = entries["pos"] <= n - -(-8 * n // 9) + entries["l"] - 1
    one[~counts] = 0
    near = np.bitwise_or.reduceat(one, begins, axis=0)
    extra = np.add.reduceat(counts.astype(np.int64), begins) - np.bitwise_count(near).sum(axis=1, dtype=np.int64)
    entries["near"], entries["extra"] = np.repeat(near, sizes, axis=0), np.repeat(extra, sizes)
    return entries


def _could_share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """No fewer than the shared shingles that count for each pair.

    Those that count are in the `near` map of the smaller document and in the map of the other; of
    two of one size, in both `near` maps. Shingles that fall together in one bit of a map are at most
    as many as its `extra`.
    """

    def bound(small, large, bits):
        return np.bitwise_count(small["near"] & large[bits]).sum(axis=-1, dtype=np.int64) + small["extra"]

    same = np.minimum(bound(x, y, "near"), bound(y, x, "near"))
    return np.where(x["n"] == y["n"], same, np.where(x["n"] < y["n"], bound(x, y, "bits"), bound(y, x, "bits")))


def _cross_pairs(postings: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """Pairs of different components among all postings."""
    named = (
        _unpacked(postings).repartition(shards, "doc")
        .join(labels, F.col("doc") == labels["node"], "left")
        .select("key", "doc", "n", "pos", "l", F.coalesce("component", "doc").alias("comp"))
    )

    def pack(batches):
        parts = []
        for batch in batches:
            e = np.zeros(batch.num_rows, _ENTRY_C)
            for name, column in zip(("key", "doc", "n", "pos", "l", "comp"), batch.columns, strict=True):
                values = column.to_numpy()
                e[name] = values.view(np.uint64) if name == "key" else values
            parts.append(e)
        if sum(map(len, parts)):
            yield _sharded(_with_bitmaps(np.concatenate(parts)), shards)

    def run(batches):
        e = _gathered(batches, _ENTRY_C, 1)
        e = e[np.argsort(e["key"], kind="stable")]
        begins, lengths = _runs(e)
        if not len(begins):
            return
        mixed = np.minimum.reduceat(e["comp"], begins) != np.maximum.reduceat(e["comp"], begins)
        begins, lengths = begins[mixed], lengths[mixed]
        two = begins[lengths == 2]
        fine, asked = _passing(e[two], e[two + 1])
        fine &= _could_share(e[two], e[two + 1]) >= asked
        pairs = [(e["doc"][two][fine], e["doc"][two + 1][fine], asked[fine])]
        held = 0
        for at, n in zip(begins[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
            group = e[at : at + n]
            for i in range(n - 1):
                rest = group[i + 1 :]
                rest = rest[rest["comp"] != group["comp"][i]]
                fine, asked = _passing(group[i], rest)
                fine &= _could_share(group[i], rest) >= asked
                if fine.any():
                    pairs.append((np.full(int(fine.sum()), group["doc"][i]), rest["doc"][fine], asked[fine]))
                    held += len(pairs[-1][0])
            if held > 500_000:
                yield _pair_batch(pairs)
                pairs, held = [], 0
        if pairs:
            yield _pair_batch(pairs)

    sharded = named.mapInArrow(pack, "shard int, entries binary")
    return sharded.repartition(shards, "shard").mapInArrow(run, _PAIRS)


def _candidates(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("l").alias("l")).where("shared >= l").select("a", "b")


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets."""

    def load(batches):
        for batch in batches:
            for ids, sets in shingle_sets(batch):
                data = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, data], ["doc", "shingles"])

    def verify(batches):
        for batch in batches:
            fine = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                fine.append(100 * common >= 80 * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    spark = docs.sparkSession
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    found = docs.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    with arrow_batches(spark, TEXT_ROWS):
        sets = written(found.mapInArrow(load, "doc bigint, shingles binary"))
    checked = (
        pairs.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b")
        .join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a")
        .select("a", "b", "x", "y")
        .mapInArrow(verify, "a bigint, b bigint")
    )
    with arrow_batches(spark, PAIR_ROWS):
        return written(checked)


def _by_rows(docs: DataFrame, without_id: DataFrame) -> DataFrame:
    """`jaccard_components` where a doc_id bears different texts: rows get ids of their own, written once."""
    key = F.monotonically_increasing_id().alias("key")
    keyed = written(docs.where("doc_id IS NOT NULL").select(key, "doc_id", "text"))
    found = jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"), own_ids=True)
    found = found.select(F.col("doc_id").alias("key"), "n_shingles", F.col("component_id").alias("component"))
    placed = written(found.join(keyed.select("key", "doc_id"), "key").drop("key"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "component").select("doc_id", "n_shingles", "component_id")
    return named.union(without_id.select("doc_id", "n_shingles", "doc_id"))


def jaccard_components(docs: DataFrame, own_ids: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of `docs`.

    With `own_ids` the caller vouches that no two rows share a doc_id; otherwise that is looked up.
    """
    shards = partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        first = written(_first_pass(docs))
    rows = first.where("segment IS NULL").select("doc_id", "n_shingles", "digest")
    levels = _levels(first.where("segment IS NOT NULL").select("segment", "counts"))

    known = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    if not own_ids:
        sets = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.min("digest").alias("first"), F.max("digest").alias("last"), F.min(F.col("digest").isNull()).alias("full"),
            F.max(F.col("digest").isNull()).alias("empty"),
        )
        if sets.where("first <> last OR full <> empty").limit(1).count():
            return _by_rows(docs, rows.where("doc_id IS NULL"))
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("size")))
    copies = written(
        known.join(classes.where("size > 1"), "digest").where("doc_id <> head").select("doc_id").distinct()
    )
    heads = docs.where("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti")

    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        postings = written(_pivot_pairs(_prefixes(heads, levels, shards), shards))
    near = written(_candidates(postings.where("entries IS NULL").select("a", "b", "l", "shared")))
    links = _linked(near, docs)
    labels = components(links)

    cross = _cross_pairs(postings.where("entries IS NOT NULL").select("entries"), labels, shards)
    far = written(_candidates(cross).join(near, ["a", "b"], "left_anti"))
    if far.limit(1).count():
        more = _linked(far, docs)
        if more.limit(1).count():
            labels = components(links.union(more))

    named = written(
        classes.where("size > 1").join(labels, F.col("head") == F.col("node"), "left")
        .select("digest", F.coalesce("component", "head").alias("component"))
        .union(classes.where("size = 1").join(labels, F.col("head") == F.col("node")).select("digest", "component"))
    )
    # Empty sets have no digest; they stay out of the join, where they would all meet in one task.
    with_digest, without = rows.where("digest IS NOT NULL"), rows.where("digest IS NULL")
    placed = with_digest.join(named, "digest", "left").select("doc_id", "n_shingles", "component")
    placed = placed.union(without.select("doc_id", "n_shingles", "doc_id"))
    return placed.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
