"""Hourly occupancy and the averages over it.

The stored form is the run: a sensor, its first hour, how many hours it lasts, and the occupied
seconds in each of them. A stay gives at most two hours of its own and leaves a level between them,
so the work does not depend on how long it lasts; overlapping stays add up in a sweep over their ends.
A cell is a run of one hour; runs are expanded into cells only where a row per hour is the result, and
whatever takes runs takes cells too.

Averages differ in the hours a sensor is averaged over:

grid      every hour between the first arrival and the last departure
observed  every hour in which any sensor was occupied
sparse    only the sensor's own cells

Zero-filled averages divide by the number of sensors and hours; the empty cells are never built.
Shares are BIGINT hundredths of a percent (`pct100`), so every sum is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkpulse.functions.numbers import ratio, rounded_ratio, rounded_units
from parkpulse.functions.timeparts import (
    hour_floor,
    hour_number,
    hour_start,
    in_days,
    inside_cycle,
    second_of_day,
    seconds_into_hour,
    whole_hours,
)
from parkpulse.operators.parse import site_of


def _div(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by))


def _stay_ends(stays: DataFrame) -> DataFrame:
    """The first and last hour of each stay with the seconds in them. A stay ending exactly on the hour
    still touches that hour, with 0 seconds. `opens` and `closes` count what lasts beyond an hour, and
    what ends in it."""
    number, offset, dwell = hour_number(F.col("in_ts")), seconds_into_hour(F.col("in_ts")), F.col("dwell_sec")
    ends = stays.select(
        "sensor", number.alias("first"), offset.alias("offset"), "dwell_sec",
        (number + _div(offset + dwell, 3600)).alias("last"),
    )

    def end(hour: Column, seconds: Column, opens: int, closes: int) -> Column:
        return F.struct(
            hour.alias("number"), seconds.alias("occupied_sec"),
            F.lit(opens).cast("bigint").alias("opens"), F.lit(closes).cast("bigint").alias("closes"),
        )

    first, last, offset = F.col("first"), F.col("last"), F.col("offset")
    both = F.array(end(first, 3600 - offset, 1, 0), end(last, F.pmod(offset + dwell, F.lit(3600)), 0, 1))
    only = F.array(end(first, dwell, 0, 0))
    return ends.select("sensor", F.inline(F.when(last > first, both).otherwise(only)))


def hour_runs(stays: DataFrame) -> DataFrame:
    """Runs (sensor, site, hour, hours, occupied_sec, pct100); overlapping stays add up.

    The ends are added up by sensor and hour before they are shuffled, so the window over a sensor has
    a row per hour of the calendar at most, however many stays there are.
    """
    summed = _stay_ends(stays).groupBy("sensor", "number").agg(
        F.sum("occupied_sec").alias("occupied_sec"), F.sum("opens").alias("opens"), F.sum("closes").alias("closes")
    )
    order = Window.partitionBy("sensor").orderBy("number")
    after = F.sum(F.col("opens") - F.col("closes")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = summed.withColumns({"after": after, "gap": F.lead("number").over(order) - F.col("number") - 1})
    own = F.struct(
        F.col("number"), F.lit(1).cast("bigint").alias("hours"),
        (F.col("occupied_sec") + (F.col("after") - F.col("opens")) * 3600).alias("occupied_sec"),
    )
    between = F.struct((F.col("number") + 1).alias("number"), F.col("gap").alias("hours"), (F.col("after") * 3600).alias("occupied_sec"))
    has_between = (F.col("after") > 0) & (F.col("gap") > 0)
    runs = swept.select("sensor", F.inline(F.when(has_between, F.array(own, between)).otherwise(F.array(own))))
    return runs.select(
        "sensor", site_of(F.col("sensor")).alias("site"), hour_start(F.col("number")).alias("hour"), "hours", "occupied_sec",
        rounded_units(F.col("occupied_sec") * 100, 3600, 2).alias("pct100"),
    )


def as_cells(runs: DataFrame) -> DataFrame:
    """One row per sensor and hour."""
    later = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("hours") - 1)).alias("later")
    columns = [c for c in runs.columns if c != "hours"]
    expanded = runs.select(*columns, later)
    hour = F.col("hour") + F.make_dt_interval(F.lit(0), F.col("later").cast("int"))
    return expanded.withColumn("hour", hour).select(*columns)


def hourly_occupancy(stays: DataFrame) -> DataFrame:
    """Cells (sensor, site, hour, occupied_sec, pct100); overlapping stays add up."""
    return as_cells(hour_runs(stays))


def stay_hours(stays: DataFrame) -> DataFrame:
    """One row per clock hour a stay touches, with the seconds of the stay inside it."""
    offset = seconds_into_hour(F.col("in_ts"))
    last = _div(offset + F.col("dwell_sec"), 3600)
    start = F.col("hour_no") * 3600 - F.col("offset")
    inside = F.least(F.col("dwell_sec"), start + 3600) - F.greatest(F.lit(0), start)
    return stays.select(
        "sensor", "in_ts", "dwell_sec", offset.alias("offset"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("hour_no"),
    ).select(
        "sensor",
        (
            hour_floor(F.col("in_ts"))
            + F.make_dt_interval(F.lit(0), F.col("hour_no").cast("int"))
        ).alias("hour"),
        "hour_no",
        inside.alias("occupied_sec"),
    )


def cells_in_days(stays: DataFrame, first: str, last: str) -> DataFrame:
    """Cells of an inclusive day range. Stays that cannot touch the range are dropped first, and runs
    are cut to it before they are expanded; a stay over midnight counts on both days."""
    touching = stays.where(
        (F.col("out_ts") >= F.lit(first).cast("timestamp_ntz"))
        & (F.col("in_ts") < F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    )
    return as_cells(_cut_to_days(hour_runs(touching), first, last).where(F.col("hours") > 0))


def seconds_by_hour_of_day(stays: DataFrame) -> DataFrame:
    """sensor, hour (of day), occupied_sec: at most 24 rows per stay, by arithmetic on its two ends."""
    day, start = 86_400, second_of_day(F.col("in_ts"))
    spans = stays.where(F.col("dwell_sec") > 0).select("sensor", start.alias("start"), (start + F.col("dwell_sec")).alias("end"))
    touched = F.least(F.lit(24), _div(F.col("end") + 3599, 3600) - _div(F.col("start"), 3600))
    parts = spans.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), touched - 1)).alias("i"))
    hour = F.pmod(_div(F.col("start"), 3600) + F.col("i"), F.lit(24))
    inside = inside_cycle(F.col("end"), day, hour * 3600, 3600) - inside_cycle(F.col("start"), day, hour * 3600, 3600)
    return parts.select("sensor", hour.cast("int").alias("hour"), inside.alias("occupied_sec"))


# Buckets an hour can fall into: hours in one of them, and how many there are.
BUCKETS = {"hour": (1, 24), "weekday": (24, 7)}


def _touched(part: str) -> Column:
    """How many buckets a run touches."""
    length, size = BUCKETS[part]
    inside = F.lit(0) if part == "hour" else F.hour("hour")
    return F.least(F.lit(size), _div(inside + F.col("hours") - 1, length) + 1)


def _nth_bucket(part: str, i: Column) -> tuple[Column, Column]:
    """(bucket, hours in it) of the i-th bucket from the run's `hour` on."""
    length, size = BUCKETS[part]
    at = (F.hour("hour") if part == "hour" else F.weekday("hour") * 24 + F.hour("hour")).cast("bigint")
    bucket = F.pmod(_div(at, length) + i, F.lit(size))
    start, cycle = bucket * length, length * size
    inside = inside_cycle(at + F.col("hours"), cycle, start, length) - inside_cycle(at, cycle, start, length)
    return bucket.cast("int"), inside


def observed_sums(cells: DataFrame, part: str, group: str | None = None, days: tuple[str, str] | None = None) -> DataFrame:
    """All that an observed mean needs, as sums by (unit, bucket, sensor, number), in one shuffle.

    A run gives its percent to every bucket it touches, a row that names its sensor, and, for the hours
    observed at all, a step up and a step down at its ends. The sums number as the units times buckets,
    the sensors and the hours of the calendar.
    """
    runs = cells if "hours" in cells.columns else cells.withColumn("hours", F.lit(1).cast("bigint"))
    runs = runs.withColumn("unit", F.col(group) if group else F.lit("all"))
    if days:
        runs = _cut_to_days(runs, *days)
    runs = runs.withColumn("touched", F.when(F.col("hours") > 0, _touched(part)))
    # Numbered from 1: its sensor, its two ends, its buckets.
    parts = runs.select(
        "unit", "sensor", "hour", "hours", "pct100",
        F.explode(F.sequence(F.lit(-2).cast("bigint"), F.coalesce(F.col("touched"), F.lit(-2)))).alias("i"),
    )
    i = F.col("i")
    bucket, inside = _nth_bucket(part, i - 1)
    number = hour_number(F.col("hour"))
    rows = parts.select(
        F.when((i > 0) | (i == -2), F.col("unit")).alias("unit"),
        F.when(i > 0, bucket).alias("bucket"),
        F.when(i == -2, F.col("sensor")).alias("sensor"),
        F.when(i == -1, number).when(i == 0, number + F.col("hours")).alias("number"),
        F.when(i > 0, inside * F.col("pct100")).when(i == 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint").alias("value"),
    )
    return rows.groupBy("unit", "bucket", "sensor", "number").agg(F.sum("value").alias("value"))


def _of_sums(sums: DataFrame, has: str) -> DataFrame:
    """The sums that have a value in a column of their key. The condition on the partition, always
    true, keeps the other one above the sums, so that all readers of the sums share their shuffle."""
    return sums.where(F.when(F.spark_partition_id() >= 0, F.col(has).isNotNull()))


def _cut_to_days(runs: DataFrame, first: str, last: str) -> DataFrame:
    """Runs without their hours outside an inclusive day range, also those with none left."""
    low = hour_number(F.lit(first).cast("timestamp_ntz"))
    high = hour_number(F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    number = hour_number(F.col("hour"))
    cut = runs.withColumns({"low": F.greatest(number, low), "high": F.least(number + F.col("hours"), high)})
    hours = F.greatest(F.lit(0).cast("bigint"), F.col("high") - F.col("low"))
    return cut.withColumns({"hour": hour_start(F.col("low")), "hours": hours}).drop("low", "high")


def _observed_hours(sums: DataFrame, part: str) -> Column:
    """Hours in which any sensor was occupied, by bucket: an array of at most 24, as one scalar.

    A sweep over the steps, of which there is one per hour of the calendar at most.
    """
    steps = _of_sums(sums, "number").select("number", F.col("value").alias("step"))
    order = Window.orderBy("number")
    level = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = steps.withColumns({"level": level, "hours": F.lead("number").over(order) - F.col("number")})
    runs = swept.where(F.col("level") > 0).select(hour_start(F.col("number")).alias("hour"), "hours")
    parts = runs.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), _touched(part) - 1)).alias("i"))
    bucket, inside = _nth_bucket(part, F.col("i"))
    counts = parts.groupBy(bucket.alias("bucket")).agg(F.sum(inside).alias("hours"))
    return counts.agg(F.collect_list(F.struct("bucket", "hours")).alias("hours")).scalar()


def mean_of_sums(sums: DataFrame, part: str, group: str | None = None, digits: int = 1) -> DataFrame:
    """The observed mean from `observed_sums` of the same `group`."""
    units = _of_sums(sums, "unit").groupBy("unit").agg(
        F.count("sensor").alias("sensors"),
        # At most 24.
        F.map_from_entries(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "value")))).alias("shares"),
    )
    rows = units.withColumn("observed", _observed_hours(sums, part)).select("unit", "sensors", "shares", F.inline("observed"))
    key = [F.col("unit").alias(group)] if group else []
    total = F.coalesce(F.try_element_at("shares", F.col("bucket")), F.lit(0).cast("bigint"))
    mean = rounded_ratio(total, F.col("sensors") * F.col("hours") * 100, digits)
    return rows.where(F.col("hours") > 0).select(*key, F.col("bucket").alias(part), mean.alias("occupancy_pct"))


def together(sums: DataFrame) -> DataFrame:
    """`observed_sums` by group made into those over all sensors; a sensor belongs to one group."""
    unit = F.when(F.col("unit").isNotNull(), F.lit("all")).alias("unit")
    return sums.groupBy(unit, "bucket", "sensor", "number").agg(F.sum("value").alias("value"))


def observed_mean(
    cells: DataFrame,
    part: str,
    group: str | None = None,
    days: tuple[str, str] | None = None,
    digits: int = 1,
) -> DataFrame:
    """Zero-filled mean percent per hour of day or weekday, over all sensors or per `group`
    ('site' or 'sensor'), from runs or cells.

    The sensors counted are those with any cell, the hours those observed inside `days`.
    """
    return mean_of_sums(observed_sums(cells, part, group, days), part, group, digits)


def sparse_mean(cells: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Mean percent over existing cells only, per the given keys."""
    return (
        cells.groupBy(*[c.alias(n) for n, c in keys.items()])
        .agg(F.sum("pct100").alias("total"), F.count(F.lit(1)).alias("cells"))
        .select(*keys, ratio(F.col("total"), F.col("cells") * 100).alias("occupancy_pct"))
    )


def mean_over_sites(by_site: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Unweighted mean of site means."""
    return by_site.groupBy(*keys).agg(
        F.round(F.avg("occupancy_pct"), digits).alias("occupancy_pct")
    )


def grid_bounds(stays: DataFrame) -> DataFrame:
    """One row: first and last hour of the dense grid.

    The grid steps by whole hours from the first arrival up to an hour after the last departure.
    """
    span = stays.agg(F.min("in_ts").alias("first_in"), F.max("out_ts").alias("last_out"))
    hours = whole_hours(F.col("first_in"), F.col("last_out"))
    first = hour_floor(F.col("first_in"))
    return span.select(
        first.alias("first_hour"),
        (first + F.make_dt_interval(F.lit(0), hours.cast("int") + 1)).alias("last_hour"),
    )


def _with_grid(df: DataFrame, stays: DataFrame) -> DataFrame:
    """Put the bounds beside every row; they are two values, read by one scalar subquery."""
    bounds = grid_bounds(stays).select(F.struct("first_hour", "last_hour")).scalar()
    return df.withColumn("grid", bounds).select("*", "grid.*").drop("grid")


def _grid_hours() -> Column:
    return whole_hours(F.col("first_hour"), F.col("last_hour")) + 1


def dense_grid(sensors: DataFrame, stays: DataFrame) -> DataFrame:
    """Every sensor at every hour of the grid, with 0 where it was free."""
    hours = F.sequence("first_hour", "last_hour", F.expr("INTERVAL 1 HOUR"))
    empty = _with_grid(sensors, stays).select(
        "sensor", F.explode(hours).alias("hour"), F.lit(0).cast("bigint").alias("occupied_sec")
    )
    cells = hourly_occupancy(stays).select("sensor", "hour", "occupied_sec")
    return (
        empty.unionByName(cells)
        .groupBy("sensor", "hour")
        .agg(F.sum("occupied_sec").alias("occupied_sec"))
    )


def hour_profile(sensors: DataFrame, stays: DataFrame) -> DataFrame:
    """Mean occupied fraction per sensor and hour of day over the dense grid, for all sensors.

    An hour of day outside a grid shorter than a day is NULL.
    """
    every_hour = F.explode(F.sequence(F.lit(0), F.lit(23)))
    empty = sensors.select(
        "sensor", every_hour.alias("hour"), F.lit(0).cast("bigint").alias("occupied_sec")
    )
    sums = (
        empty.unionByName(seconds_by_hour_of_day(stays))
        .groupBy("sensor", "hour")
        .agg(F.sum("occupied_sec").alias("occupied_sec"))
    )
    # How often an hour of day occurs: once per whole day, and once more inside the rest.
    since_first = F.pmod(F.col("hour") - F.hour("first_hour"), F.lit(24))
    times = F.call_function("div", _grid_hours() - since_first + 23, F.lit(24))
    fraction = ratio(F.col("occupied_sec"), F.nullif(times, F.lit(0)) * 3600)
    return _with_grid(sums, stays).select("sensor", "hour", fraction.alias("fraction"))


def transposed_profile(profile: DataFrame) -> DataFrame:
    """One row per sensor, one column per hour of day (h00 to h23)."""
    wide = profile.groupBy("sensor").pivot("hour", list(range(24))).agg(F.first("fraction"))
    return wide.select("sensor", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def column_summary(sensors: DataFrame, stays: DataFrame) -> DataFrame:
    """Minimum, quartiles, mean and maximum of each sensor's column of the dense grid, as fractions.

    A value comes with the number of hours that have it: runs as they are, and one row for the free
    hours. Quartiles are picked by rank from running sums of these numbers.
    """
    counted = hour_runs(stays).groupBy("sensor", "occupied_sec").agg(F.sum("hours").alias("times"))
    blank = sensors.select(
        "sensor", F.lit(None).cast("bigint").alias("occupied_sec"),
        F.lit(0).cast("bigint").alias("times"),
    )
    cells = F.sum("times").over(Window.partitionBy("sensor"))
    free = F.when(F.col("occupied_sec").isNull(), _grid_hours() - F.col("cells"))
    values = (
        _with_grid(counted.unionByName(blank).withColumn("cells", cells), stays)
        .select(
            "sensor", F.coalesce("occupied_sec", F.lit(0)).alias("occupied_sec"),
            F.coalesce(free, "times").alias("times"),
        )
        .where(F.col("times") > 0)
    )
    by_value = Window.partitionBy("sensor").orderBy("occupied_sec", "times")
    until = F.sum("times").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = values.withColumns({"until": until, "hours": F.sum("times").over(Window.partitionBy("sensor"))})

    def at_rank(rank: Column) -> Column:
        """The value at a rank counted from 0: that of the row whose hours hold it."""
        return F.max(F.when((F.col("until") > rank) & (F.col("until") - F.col("times") <= rank), F.col("occupied_sec")))

    # The k-th quartile stands at rank (hours - 1) * k / 4, between two values if that is no whole number.
    quarters = {k: (F.col("hours") - 1) * k for k in (1, 2, 3)}
    summed = ranked.groupBy("sensor").agg(
        F.min("occupied_sec").alias("low"), F.max("occupied_sec").alias("high"),
        F.sum(F.col("occupied_sec") * F.col("times")).alias("total"), F.max("hours").alias("hours"),
        *[at_rank(_div(q, 4)).alias(f"below{k}") for k, q in quarters.items()],
        *[at_rank(_div(q + 3, 4)).alias(f"above{k}") for k, q in quarters.items()],
    )

    def quartile(k: int) -> Column:
        part = F.pmod((F.col("hours") - 1) * k, F.lit(4)) / F.lit(4.0)
        between = F.col(f"below{k}") + (F.col(f"above{k}") - F.col(f"below{k}")) * part
        return F.round(between / F.lit(3600.0), 6)

    return summed.select(
        "sensor",
        ratio(F.col("low"), 3600).alias("minimum"),
        quartile(1).alias("q1"),
        quartile(2).alias("median"),
        ratio(F.col("total"), F.col("hours") * 3600).alias("mean"),
        quartile(3).alias("q3"),
        ratio(F.col("high"), 3600).alias("maximum"),
    )


def to_wide(cells: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """hour plus one percent column per named sensor, 0 where free.

    For export. The columns are exactly the sensors named; the long form is the complete result. The
    rows are the hours observed for any sensor.
    """
    percent = F.col("pct100") / F.lit(100.0)
    columns = [F.coalesce(F.max(F.when(F.col("sensor") == s, percent)), F.lit(0.0)).alias(s) for s in sensors]
    return cells.groupBy("hour").agg(*columns)


def from_wide(wide: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Back to long form: one row per key and value column."""
    columns = [F.col(f"`{c}`") for c in wide.columns if c != key]
    return wide.unpivot([key], columns, name, value)
