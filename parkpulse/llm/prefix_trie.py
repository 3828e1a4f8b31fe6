"""The trie of the prefixes that conversations share, built as double arrays.

1. Each conversation is rebuilt: its first turns are taken from the conversation at the head of its
   block, as many as the checksum of its id says. Only hashes and lengths of turns move.
2. Every prefix gets a key of 128 bits that can be summed up along a conversation (the exclusive or
   of hashes of place and turn), so that any piece of a conversation knows where it hangs.
3. Conversations are cut into segments of at most SEGMENT turns. Equal segments below one prefix
   become one row with the number of their conversations and the smallest of them.
4. Segments are dealt by range of prefix and path. A task packs each batch of them, a prefix shard,
   into BASE and CHECK arrays over dense turn ids, walks the arrays and adds up what each node holds.
5. Nodes on the border of shards are in several of them; their aggregates are merged globally by key.
6. A node belongs to its smallest conversation, so what a conversation owns is the end of its path.
   Sums over subtrees are running sums along the owned ends, added to the nodes above each of them.

No step holds a conversation, a node's members or a shard of unknown size at once: running values are
carried over range partitions (`running`), segments and batches are bounded, and the ids that end at
a node pass through its hash as a stream of packed chunks (a hash is sequential by nature).

Turns are ordered by `turn`, null first, ties by the MD5 of role and text; null role or text is
empty. Repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are
left out. Texts are only hashed and measured, whatever their length. Turns count as equal by 128 bits
of hash. An empty table has no nodes, not even the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkpulse.llm.shared import partitions, read_table, written

BLOCK = 100
MODULUS = 6
#: Turns of a segment.
SEGMENT = 16
_FREE, _ROOT = -1, -2
_PART = "range_part"
_KEY = ("depth", "k1", "k2")


def running(df: DataFrame, key: str, order: list[Column], combine: str, **values: Column) -> DataFrame:
    """Add running values ('sum' or 'bit_xor') along the rows of each key, with no key in one task.

    Rows are dealt by range of key and order and written; windows run inside a range, and the totals of
    the ranges before are carried over. A range holds at most one key that began before it, so the table
    of carried totals has no more rows than there are ranges, and is broadcast.
    """
    spark = df.sparkSession
    total = getattr(F, combine)
    dealt = df.withColumns(values).repartitionByRange(partitions(spark), key, *order)
    table = written(dealt.withColumn(_PART, F.spark_partition_id()))
    inside = Window.partitionBy(_PART, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        table.groupBy(key, _PART)
        .agg(*[total(v).alias(v) for v in values])
        .select(F.col(key).alias("carried_key"), _PART, *[total(v).over(before).alias(f"carried_{v}") for v in values])
        .where(F.col(f"carried_{next(iter(values))}").isNotNull())
    )
    carried = F.broadcast(carried.withColumnRenamed(_PART, "carried_part"))
    here = (F.col(_PART) == F.col("carried_part")) & (F.col(key) == F.col("carried_key"))
    local = table.withColumns({v: total(v).over(inside) for v in values}).join(carried, here, "left")
    zero = F.lit(0).cast("bigint")

    def joined(v: str) -> Column:
        rest = F.coalesce(F.col(f"carried_{v}"), zero)
        return (F.col(v).bitwiseXOR(rest) if combine == "bit_xor" else F.col(v) + rest).alias(v)

    return local.select(*df.columns, *[joined(v) for v in values])


class DoubleArray:
    """A trie in two arrays: from node s, code c leads to t = base[s] + c if check[t] == s.

    Node 0 is the root. All children of a node are added by one call, so none ever moves.
    """

    def __init__(self, codes: int):
        self.codes = codes
        self.base = np.zeros(1, np.int64)
        self.check = np.full(1, _ROOT, np.int64)
        #: All places from here on are free.
        self.used = 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, _FREE, np.int64))

    def _fit(self, labels: np.ndarray) -> int:
        """A base at which all labels (rising) fall on free places; behind all nodes there is one."""
        recent = max(0, self.used - 4096)
        for place in (recent + np.flatnonzero(self.check[recent : self.used] == _FREE)[:16]).tolist():
            at = place - labels[0] + labels
            if (self.check[at[at < self.used]] == _FREE).all():
                break
        else:
            place = self.used
        end = int(place + labels[-1] - labels[0]) + 1
        self._grow(end)
        self.used = max(self.used, end)
        return place - int(labels[0])

    def extend(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Add the child of each pair and return the children, by pair."""
        pairs, of = np.unique(states * self.codes + codes, return_inverse=True)
        parents, labels = pairs // self.codes, pairs % self.codes
        begins = np.flatnonzero(np.append(True, parents[1:] != parents[:-1])) if len(pairs) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(pairs)))
        slots = np.empty(len(pairs), np.int64)
        for first, n in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            mine = labels[first : first + n]
            self.base[parents[first]] = base = self._fit(mine)
            slots[first : first + n] = base + mine
            self.check[base + mine] = parents[first]
        # An only child may take any free place.
        single = begins[sizes == 1]
        free = np.flatnonzero(self.check == _FREE)
        if len(free) < len(single):
            self._grow(len(self.check) + len(single))
            free = np.flatnonzero(self.check == _FREE)
        slots[single] = free = free[: len(single)]
        self.used = max(self.used, int(free.max(initial=0)) + 1)
        self.base[parents[single]] = slots[single] - labels[single]
        self.check[slots[single]] = parents[single]
        return slots[of]

    def walk(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each pair, -1 where there is none."""
        to = self.base[states] + codes
        there = (to >= 0) & (to < len(self.check))
        there[there] = self.check[to[there]] == states[there]
        return np.where(there, to, -1)


_PARTIALS = "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, chars bigint, n_convs bigint, conv_id bigint"


def shard_nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Partial aggregates of the nodes of one batch of segments."""
    start, p1, p2 = (batch.column(i).to_numpy() for i in range(3))
    n, conv = batch.column(4).to_numpy(), batch.column(5).to_numpy()
    lists = batch.column(3)
    at = lists.offsets.to_numpy().astype(np.int64)
    steps = lists.values
    turn, k1, k2, chars = (steps.field(i) for i in range(4))
    dense = turn.dictionary_encode()
    code = dense.indices.to_numpy().astype(np.int64)
    k1, k2, chars = k1.to_numpy(), k2.to_numpy(), chars.to_numpy()
    size = np.diff(at)
    # A prefix is the first step of its segments, behind the codes of the turns.
    prefixes, prefix = np.unique(np.stack([start, p1, p2], 1), axis=0, return_inverse=True)
    turns = len(dense.dictionary)
    trie = DoubleArray(turns + len(prefixes))
    top = turns + prefix.ravel()
    states = trie.extend(np.zeros(len(size), np.int64), top)
    for d in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > d)
        states[rows] = trie.extend(states[rows], code[at[rows] + d])
    # All segments again, from the root, adding up what passes each node.
    places = len(trie.check)
    members, first = np.zeros(places, np.int64), np.full(places, np.iinfo(np.int64).max)
    depth, step, above = (np.zeros(places, np.int64) for _ in range(3))
    states = trie.walk(np.zeros(len(size), np.int64), top)
    begin = np.full(places, -1, np.int64)
    begin[states] = np.arange(len(size))
    seen = [np.zeros(0, np.int64)]
    for d in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > d)
        old, new = states[rows], trie.walk(states[rows], code[at[rows] + d])
        np.add.at(members, new, n[rows])
        np.minimum.at(first, new, conv[rows])
        depth[new], step[new], above[new] = start[rows] + d + 1, at[rows] + d, old
        states[rows] = new
        seen.append(np.unique(new))
    node = np.concatenate(seen)
    own, up = step[node], above[node]
    is_top = begin[up] >= 0
    row = np.maximum(begin[up], 0)
    columns = (
        depth[node], k1[own], k2[own], np.where(is_top, p1[row], k1[step[up]]), np.where(is_top, p2[row], k2[step[up]]),
        chars[own].astype(np.int64), members[node], first[node],
    )
    names = ["depth", "k1", "k2", "p1", "p2", "chars", "n_convs", "conv_id"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, pos (from 1), hash, chars."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("hash"),
        F.length(text).alias("chars"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("hash")]
    return running(turns, "conv_id", order, "sum", pos=F.lit(1).cast("bigint"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, hash, chars of all rebuilt turns; conv_id, size of all conversations).

    A conversation's own first h turns give way to the first h of the conversation at the head of its
    block of BLOCK ids, where h is the checksum of its id modulo MODULUS.
    """
    turns = written(turns)
    head = turns.where((F.col("pos") < MODULUS) & (F.col("conv_id") % BLOCK == 0)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash", "chars"))).alias("head")
    )  # At most MODULUS - 1 turns.
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MODULUS
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h)
    convs = sizes.join(
        head.withColumnRenamed("conv_id", "head_id"), F.col("conv_id") - F.col("conv_id") % BLOCK == F.col("head_id"), "left"
    ).select("conv_id", "n", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array()).alias("taken"))
    k = F.size("taken").cast("bigint")
    convs = written(convs.withColumns({"k": k, "size": k + F.greatest(F.lit(0), F.col("n") - F.col("h"))}))
    own = (
        turns.join(convs.select("conv_id", "h", "k"), "conv_id")
        .where(F.col("pos") > F.col("h"))
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "hash", "chars")
    )
    taken = convs.select("conv_id", F.inline("taken"))
    return own.unionByName(taken), convs.select("conv_id", "size")


def prefix_paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, hash, chars, key of the prefix (k1, k2) and of the one before (p1, p2)."""
    terms = {"t1": F.xxhash64("pos", "hash"), "t2": F.xxhash64("hash", "pos")}
    keyed = running(turns.withColumns(terms), "conv_id", [F.col("pos")], "bit_xor", k1=F.col("t1"), k2=F.col("t2"))
    return keyed.select(
        "conv_id", F.col("pos").alias("depth"), "hash", "chars", "k1", "k2",
        F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"),
    )


def trie_nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes by key with their parent's key, chars, n_convs, and conv_id, the smallest member."""
    spark = paths.sparkSession
    start = (F.col("depth") - 1) - (F.col("depth") - 1) % SEGMENT
    step = F.struct("depth", F.col("hash").alias("turn"), "k1", "k2", "chars")
    pieces = paths.groupBy("conv_id", start.alias("start")).agg(
        F.sort_array(F.collect_list(step)).alias("path"),  # SEGMENT steps at most
        F.min_by(F.struct("p1", "p2"), "depth").alias("p"), F.max_by(F.struct(*_KEY), "depth").alias("end"),
    )
    # Two pieces that start at one depth and end at one node are equal all along.
    segments = pieces.groupBy("start", "p", "end").agg(
        F.first("path").alias("path"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")
    )
    path = F.transform("path", lambda s: F.struct(s["turn"].alias("turn"), s["k1"].alias("k1"), s["k2"].alias("k2"), s["chars"].alias("chars")))
    segments = segments.select("start", "p.p1", "p.p2", path.alias("path"), "n", "conv_id").withColumn(
        "turns", F.transform("path", lambda s: s["turn"])
    )
    order = ("start", "p1", "p2", "turns")
    dealt = segments.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("turns")
    shards = dealt.mapInArrow(lambda batches: (shard_nodes(b) for b in batches if b.num_rows), _PARTIALS)
    merged = shards.groupBy(*_KEY).agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.max("chars").alias("chars"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"),
        "n_convs", "conv_id",
    )
    return merged.unionByName(root)


def _id_chunks(batches):
    """Ids that end at one node, packed by batch: key, first id, text of the comma-joined ids."""
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(4)]
        key = np.stack(columns[:3], 1)
        begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))[: len(key)])
        ids = columns[3].tolist()
        stops = np.append(begins, len(ids))[1:]
        texts = [",".join(map(str, ids[int(a) : int(z)])) for a, z in zip(begins, stops, strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c[begins]) for c in columns], pa.array(texts, pa.string())], [*_KEY, "first", "ids"])


def _id_hashes(batches):
    """SHA-256 of each node's chunks in turn; only the state of one hash is held."""
    key, state = None, None

    def rows(done):
        return pa.RecordBatch.from_pylist(done, pa.schema([*[(k, pa.int64()) for k in _KEY], ("ends_sha256", pa.string())]))

    for batch in batches:
        done = []
        chunks = zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True)
        for *own, ids in chunks:
            if own != key:
                if key:
                    done.append({**dict(zip(_KEY, key, strict=True)), "ends_sha256": state.hexdigest()})
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield rows(done)
    if key:
        yield rows([{**dict(zip(_KEY, key, strict=True)), "ends_sha256": state.hexdigest()}])


def end_hashes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Key of each node at which conversations end, and the hash of their ids in order."""
    n = partitions(paths.sparkSession)
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct(*_KEY), "depth").alias("end")).select("end.*", "conv_id")
    zero = F.lit(0).cast("bigint")
    ends = last.unionByName(convs.where("size = 0").select(*[zero.alias(k) for k in _KEY], "conv_id"))
    order = (*_KEY, "conv_id")
    chunks = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _id_chunks, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string"
    )
    return (
        chunks.repartition(n, *_KEY)
        .sortWithinPartitions(*_KEY, "first")
        .mapInArrow(_id_hashes, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(hashed_turns(conversations))
    paths = written(prefix_paths(turns))
    nodes = written(trie_nodes(paths, convs))
    key = [F.col(f"parent.{c}") for c in _KEY]
    parents = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = parents.agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, list(_KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    saved, leaf = (F.col("n_convs") - 1) * F.col("chars"), (F.col("n_children") == 0).cast("bigint")
    # Along the nodes a conversation owns, from its end upwards.
    owned = written(running(nodes, "conv_id", [F.col("depth").desc()], "sum", saved=saved, leaves=leaf))
    ends = owned.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.max("saved").alias("saved"), F.max("leaves").alias("leaves")
    )
    ends = ends.where((F.col("top") > 0) & ((F.col("saved") > 0) | (F.col("leaves") > 0)))
    above = (
        paths.select("conv_id", *_KEY)
        .join(ends, "conv_id")
        .where(F.col("depth") < F.col("top"))
        .groupBy(*_KEY)
        .agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    )
    zero = F.lit(0).cast("bigint")
    to_root = ends.agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    above = above.unionByName(to_root.select(*[zero.alias(k) for k in _KEY], "more_saved", "more_leaves"))
    empty = F.lit(hashlib.sha256().hexdigest())
    nodes_above = owned.select(*_KEY, F.col("conv_id").alias("parent_conv_id")).alias("parent")
    is_parent = (F.col("node.depth") - 1 == key[0]) & (F.col("node.p1") == key[1]) & (F.col("node.p2") == key[2])
    full = owned.join(above, list(_KEY), "left").join(end_hashes(paths, convs), list(_KEY), "left")
    return full.alias("node").join(nodes_above, is_parent, "left").select(
        "node.conv_id", "node.depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


SQL = r"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            md5(length(coalesce("role", '')) || ':' || coalesce("role", '') || coalesce(text, ''))) AS pos,
        coalesce("role", '') AS r, coalesce(text, '') AS t
    FROM conversations WHERE conv_id IS NOT NULL
), steps AS (
    SELECT list(list_reduce(list_prepend(n, range(8)),
                lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc
    FROM range(256) AS x(n)
), convs AS (
    SELECT conv_id, xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), steps
), taken AS (
    SELECT c.conv_id, pos, r, t FROM convs c JOIN turns s ON s.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
), rebuilt AS (
    SELECT * FROM taken
    UNION ALL
    SELECT conv_id, pos - h + (SELECT count(*) FROM taken WHERE taken.conv_id = turns.conv_id), r, t
    FROM turns JOIN convs USING (conv_id) WHERE pos > h
), rows_of AS (
    SELECT conv_id, pos AS depth, length(t) AS chars,
        sha256(string_agg(sha256(length(r) || ':' || r || t), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS k
    FROM rebuilt
), member AS (
    SELECT conv_id, depth, k, chars, min(conv_id) OVER (PARTITION BY k) AS node FROM rows_of
    UNION ALL SELECT conv_id, 0, '', 0, min(conv_id) OVER () FROM convs
), node AS (
    SELECT depth, node, min(chars) AS chars, count(*) AS n_convs,
        coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = size), '') AS ends
    FROM member JOIN (SELECT conv_id, max(depth) AS size FROM member GROUP BY conv_id) USING (conv_id) GROUP BY ALL
), linked AS (
    SELECT n.*, m.node AS parent FROM node n LEFT JOIN member m ON m.conv_id = n.node AND m.depth = n.depth - 1
), marked AS (
    SELECT *, (SELECT count(*) FROM linked c WHERE c.parent = l.node AND c.depth = l.depth + 1) AS n_children FROM linked l
), sums AS (
    SELECT m.depth, m.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n.chars) AS saved_tokens
    FROM marked n JOIN member m ON m.conv_id = n.node AND m.depth <= n.depth GROUP BY ALL
)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM marked JOIN sums USING (depth, node)
"""
