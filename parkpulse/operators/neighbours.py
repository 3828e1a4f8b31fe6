"""Previous and next message of the same sensor, in one plan for sensors of any size.

A window over one sensor runs in one task, so a sensor with too many rows is cut in time: a message
is shuffled by its sensor and its slice. Where to cut comes from a sample of the messages, read as a
scalar inside the plan - nothing runs before the action, and most data has no place to cut.

Slices overlap: what stands between a cut and the next sampled message goes to both, as ghosts to the
earlier slice. So the message after a cut finds the one before it there, and no row has to look across.

One sensor may also hold a pile of copies of one message. Copies go to one slice, which drops them;
of a large pile nearly all are dropped where they are read, since any sampled copy proves that the
later ones are not the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "slice"
GHOST = "ghost"
#: Rows one task may sort; a few gigabytes of messages. A slice has at least about so many.
SLICE_ROWS = 20_000_000
#: At most so many places to cut; beyond, slices grow with the data.
SLICES = 4096
#: Sampled rows from one cut to the next.
PER_SLICE = 24


def message_order() -> list[Column]:
    return [F.col("ts").asc_nulls_last(), F.col("row_id").asc()]


def _place(by_row: bool) -> Column:
    """Where a message stands among those of its sensor; never NULL."""
    fields = [
        F.col("ts").isNull().alias("late"),
        F.coalesce("ts", F.lit("1970-01-01").cast("timestamp_ntz")).alias("ts"),
    ]
    return F.struct(*fields, *([F.col("row_id").alias("row_id")] if by_row else []))


def _name() -> Column:
    return F.coalesce("sensor", F.lit(""))


def _copy(messages: DataFrame) -> list[str]:
    """Columns in which copies of a message agree: all but the row id."""
    return [c for c in messages.columns if c != "row_id"]


def cutting(messages: DataFrame, slice_rows: int = SLICE_ROWS, copies: bool = False) -> Column:
    """Where to cut, as one scalar: a map from each cut sensor to its sorted `bounds`, and `piles`.

    A bound is the `place` of a sampled message and that of the next one, `until`. One pass over
    (sensor, ts, row_id), and the payload if `copies` are to be dropped. Rows are sampled by the hash of
    their row id, PER_SLICE for every `slice_rows`, so the scalar depends on the messages alone. Above
    SLICES bounds or piles only every so many are kept: slices grow instead. With `copies` a cut never
    falls between messages of one sensor and second, for copies must meet.
    """
    share = min(1.0, PER_SLICE / slice_rows)
    limit = 2**63 - 1 if share == 1 else int((share - 0.5) * 2**64)
    sampled = messages.where(F.xxhash64("row_id") <= F.lit(limit))
    place = _place(by_row=not copies).alias("place")
    if copies:
        sampled = sampled.groupBy(*_copy(messages)).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"))
        pile = F.when(F.col("n") >= PER_SLICE, F.struct(*messages.columns))
        places = sampled.groupBy(_name().alias("name"), place).agg(F.collect_list(pile).alias("piles"))
    else:
        places = sampled.select(_name().alias("name"), place, F.array().alias("piles"))
    order = Window.partitionBy("name").orderBy("place")
    ranked = places.withColumns({"rank": F.row_number().over(order), "until": F.lead("place").over(order)})
    # One row per cut or pile: about rows / slice_rows.
    is_cut = (F.col("rank") % PER_SLICE == 0) & F.col("until").isNotNull()
    kept = ranked.where(is_cut | (F.size("piles") > 0))
    every = F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / F.lit(float(SLICES)))
    at_cut = is_cut & (F.col("rank") / PER_SLICE % F.col("every") == 0)
    by_sensor = (
        kept.withColumn("every", every)
        .groupBy("name")
        .agg(
            F.sort_array(F.collect_list(F.when(at_cut, F.struct("place", "until")))).alias("bounds"),
            F.flatten(F.collect_list("piles")).alias("piles"),
        )
    )
    bounds = F.when(F.size("bounds") > 0, F.struct("name", "bounds"))
    return by_sensor.agg(
        F.struct(
            F.map_from_entries(F.collect_list(bounds)).alias("bounds"),
            F.slice(F.flatten(F.collect_list("piles")), 1, SLICES).alias("piles"),
        )
    ).scalar()


def without_later_copies(messages: DataFrame, cut: Column) -> DataFrame:
    """Drop copies of a sampled message that come after it. The first copy always stays."""
    pile = F.filter("piles", lambda p: F.struct(*[p[c] for c in _copy(messages)]).eqNullSafe(F.struct(*_copy(messages))))
    later = F.col("row_id") > F.get(pile, F.lit(0))["row_id"]
    piled = messages.withColumn("piles", cut["piles"])
    return piled.where(~F.coalesce(F.when(F.size("piles") > 0, later), F.lit(False))).drop("piles")


def _bounds_before(place: Column) -> Column:
    """How many bounds stand at or before a place, by bisection."""
    start = F.struct(F.lit(0).alias("low"), F.size("bounds").alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        before = F.get("bounds", middle)["place"] <= place
        narrower = F.when(before, F.struct((middle + 1).alias("low"), at["high"].alias("high"))).otherwise(
            F.struct(at["low"].alias("low"), middle.alias("high"))
        )
        return F.when(at["low"] < at["high"], narrower).otherwise(at)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("bounds") + 1)).cast("int"))
    return F.aggregate(steps, start, halve, lambda at: at["low"])


def placed(messages: DataFrame, cut: Column, copies: bool = False) -> DataFrame:
    """Messages shuffled by sensor and `slice`: 0 for whole sensors, above 0 and rising with time for
    cut ones; `ghost` marks the second rows of those that also go to the slice before. A generator makes
    them, so that a place is looked up once per row."""
    found = messages.withColumn("bounds", F.try_element_at(cut["bounds"], _name()))
    place = _place(by_row=not copies)
    number = F.when(F.col("bounds").isNotNull(), _bounds_before(place)).otherwise(-1)

    def row(slice_: Column, ghost: bool) -> Column:
        return F.struct(*messages.columns, slice_.alias(SLICE), F.lit(ghost).alias(GHOST))

    # A generator of its own: `number` is used three times.
    numbered = found.select(F.inline(F.array(F.struct(*found.columns, number.alias("number")))))
    after_cut = (F.col("number") > 0) & (place <= F.get("bounds", F.col("number") - 1)["until"])
    real, ghost = row(F.col("number") + 1, False), row(F.col("number"), True)
    rows = F.when(after_cut, F.array(real, ghost)).otherwise(F.array(real))
    return numbered.select(F.inline(rows)).repartition("sensor", SLICE)


def sliced(messages: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Distinct messages shuffled by sensor and slice."""
    return placed(messages, cutting(messages.select("sensor", "ts", "row_id"), slice_rows))


def without_ghosts(messages: DataFrame) -> DataFrame:
    return messages.where(~F.col(GHOST)).drop(GHOST)


def with_neighbours(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Add structs `prev` and `next` holding `fields` of the adjacent rows of the sensor.

    A missing neighbour is a NULL struct, so it differs from a neighbour with NULL fields. Ghosts go: the
    first row after a cut stays as the ghost that saw both of its neighbours, all others as themselves.
    A `df` that has slices but no ghosts any more gets the ends of its slices by a join.
    """
    row = F.struct(*fields)
    if SLICE not in df.columns:
        w = Window.partitionBy("sensor").orderBy(*message_order())
        return df.withColumns({"prev": F.lag(row).over(w), "next": F.lead(row).over(w)})

    w = Window.partitionBy("sensor", SLICE).orderBy(*message_order())
    inside = df.withColumns({"prev": F.lag(row).over(w), "next": F.lead(row).over(w)})
    if GHOST not in df.columns:
        return _with_slice_ends(inside, df, row)
    after_ghost = F.coalesce(F.lag(GHOST).over(w), F.lit(False))
    first = F.row_number().over(w) == 1
    marked = inside.withColumn("owned", F.when(F.col(GHOST), ~after_ghost).otherwise((F.col(SLICE) <= 1) | ~first))
    return marked.where("owned").drop("owned", GHOST)


def _with_slice_ends(inside: DataFrame, df: DataFrame, row: Column) -> DataFrame:
    ends = _slice_ends(df, row)
    here = F.col("sensor").eqNullSafe(F.col("end_sensor")) & (F.col(SLICE) == F.col("end_slice"))
    return (
        inside.join(F.broadcast(ends), here, "left")
        .withColumn("prev", F.coalesce("prev", "last_before"))
        .withColumn("next", F.coalesce("next", "first_after"))
        .select(*inside.columns)
    )


def _slice_ends(df: DataFrame, row: Column) -> DataFrame:
    """Per slice of a cut sensor, the row before its first and after its last row.

    One row per (cut sensor, slice): at most bounds + cut sensors, so twice SLICES, whatever the data.
    The condition on the partition, always true, holds the other one in its place: the optimizer
    would move it below the shuffle and read the messages again.
    """
    position = F.struct(F.col("ts").isNull(), F.col("ts"), F.col("row_id"))
    ends = (
        df.where(F.when(F.spark_partition_id() >= 0, F.col(SLICE) > 0))
        .groupBy("sensor", SLICE)
        .agg(F.min_by(row, position).alias("first"), F.max_by(row, position).alias("last"))
    )
    w = Window.partitionBy("sensor").orderBy(SLICE)
    return ends.select(
        F.col("sensor").alias("end_sensor"), F.col(SLICE).alias("end_slice"),
        F.lag("last").over(w).alias("last_before"),
        F.lead("first").over(w).alias("first_after"),
    )
