"""Parking stays: an arrival paired with the next normal message of its sensor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkpulse.functions import vocabulary as V
from parkpulse.functions.timeparts import day_night, day_type, weekday_name, whole_seconds
from parkpulse.operators.neighbours import GHOST, SLICE, with_neighbours
from parkpulse.operators.parse import site_of


def pair_stays(coded: DataFrame, require_departure: bool = False) -> DataFrame:
    """Stays (sensor, site, in_ts, out_ts, dwell_sec) from coded messages.

    With guarded codes the next normal message after an arrival is always a departure. With
    precedence codes it may be another arrival; `require_departure` drops those.
    """
    kept = ["row_id", "sensor", "ts", "detector"] + [c for c in coded.columns if c in (SLICE, GHOST)]
    normal = coded.where((F.col("status_code") == V.OK) & F.col("sensor").isNotNull()).select(*kept)
    paired = with_neighbours(normal, ("ts", "detector")).where(
        F.col("detector").isin(V.PARK, V.PARK_SHORT) & F.col("next.ts").isNotNull()
    )
    if require_departure:
        paired = paired.where(F.col("next.detector").isin(V.DEPART, V.DEPART_SHORT))
    return _stays(paired)


def adjacent_stays(coded: DataFrame) -> DataFrame:
    """The stays of guarded codes that kept the `next` message, without looking for it again.

    What makes an arrival normal there - a next message that is normal by its action, in the same
    month, and no arrival - leaves that message normal too, so it is the next normal one.
    """
    arrival = (F.col("status_code") == V.OK) & (F.col("detector") == V.PARK)
    return _stays(coded.where(arrival & F.col("next.ts").isNotNull()))


def _stays(paired: DataFrame) -> DataFrame:
    return paired.select(
        "sensor",
        site_of(F.col("sensor")).alias("site"),
        F.col("ts").alias("in_ts"),
        F.col("next.ts").alias("out_ts"),
        whole_seconds(F.col("ts"), F.col("next.ts")).alias("dwell_sec"),
    )


def enrich_stays(
    stays: DataFrame,
    holidays: Sequence[str] = V.HOLIDAYS,
    new_year: tuple[str, str] | None = V.NEW_YEAR_WINDOW,
) -> DataFrame:
    """Add the rest area, the detector number, weekday, day type and day/night.

    Needs full sensor names.
    """
    name = F.split("sensor", f"{V.REST_AREA}_#", 2)
    weekday = F.weekday("in_ts")
    return stays.select(
        "sensor",
        site_of(F.col("sensor")).alias("site"),
        F.get(name, F.lit(1)).try_cast("int").alias("detector_no"),
        weekday.alias("weekday"),
        weekday_name(weekday).alias("weekday_name"),
        day_type(F.col("in_ts"), holidays, new_year).alias("day_type"),
        day_night(F.col("in_ts")).alias("day_night"),
        "in_ts", "out_ts", "dwell_sec",
    )
