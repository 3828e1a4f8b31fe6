"""Usage and dwell reports over stays: counts, means, top lists, peaks and reference values.

Reports by hour, weekday or month have at most 24 rows; the windows without keys below run on
such results only, never on messages or stays. What is compared across sites is a scalar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkpulse.functions.numbers import rounded_ratio, rounded_units
from parkpulse.functions.timeparts import calendar_bucket, grain

PEAK_FACTOR = (3, 2)  # 1.5 as a fraction, to compare whole numbers
NIGHT_END_HOUR = 5


def _all_rows():
    return Window.partitionBy()


def sensor_list(messages: DataFrame) -> DataFrame:
    return messages.select("sensor").distinct()


def data_period(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_distinct("sensor").alias("n_sensors"),
    ).select(
        "first_ts", "last_ts",
        F.date_diff("last_ts", "first_ts").alias("days"),
        "n_sensors",
    )


def usage_by(stays: DataFrame, **keys: Column) -> DataFrame:
    return stays.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.count(F.lit(1)).alias("usage_count")
    )


def usage_by_grain(stays: DataFrame, name: str) -> DataFrame:
    return usage_by(stays, **{name: grain(F.col("in_ts"), name)})


def usage_rebinned(stays: DataFrame, width: str) -> DataFrame:
    return usage_by(stays, period=calendar_bucket(F.col("in_ts"), width))


def dwell_by(stays: DataFrame, digits: int, **keys: Column) -> DataFrame:
    """Mean dwell in minutes."""
    return (
        stays.groupBy(*[c.alias(n) for n, c in keys.items()])
        .agg(F.sum("dwell_sec").alias("total"), F.count(F.lit(1)).alias("n"))
        .select(
            *keys,
            rounded_ratio(F.col("total"), F.col("n") * 60, digits).alias("dwell_min"),
        )
    )


def with_reference_count(usage: DataFrame) -> DataFrame:
    """Add the mean of the counts, without decimals."""
    w = _all_rows()
    mean = rounded_ratio(F.sum("usage_count").over(w), F.count(F.lit(1)).over(w))
    return usage.withColumn("reference", mean)


def with_reference_value(
    report: DataFrame, value: str, digits: int = 1, to: int | None = None
) -> DataFrame:
    """Add the mean of a column whose values have `digits` decimals, with `to` decimals (as many)."""
    w = _all_rows()
    units = F.round(F.col(value) * 10**digits).cast("bigint")
    to = digits if to is None else to
    mean = rounded_ratio(F.sum(units).over(w), F.count(F.lit(1)).over(w) * 10**digits, to)
    return report.withColumn("reference", mean)


def mean_value(report: DataFrame, value: str, digits: int = 1) -> Column:
    """Mean of a column whose values have `digits` decimals, with as many, as one scalar."""
    units = F.round(F.col(value) * 10**digits).cast("bigint")
    mean = rounded_ratio(F.sum(units), F.count(F.lit(1)) * 10**digits, digits)
    return report.agg(mean.alias("mean")).scalar()


def with_mean_share(by_site: DataFrame, digits: int = 1) -> DataFrame:
    """Add the mean of the site means. It is one scalar: no row is moved for it."""
    mean = by_site.agg(F.round(F.avg("occupancy_pct"), digits).alias("mean")).scalar()
    return by_site.withColumn("reference", mean)


def with_all_sites_count(usage: DataFrame, bucket: str) -> DataFrame:
    """Add to counts by site the mean count of a bucket over all sites together."""
    mean = rounded_ratio(F.sum("usage_count"), F.count_distinct(bucket))
    return usage.withColumn("reference", usage.agg(mean.alias("mean")).scalar())


def dwell_by_site_hour(stays: DataFrame) -> DataFrame:
    """Mean dwell by site and hour, and the mean of the hourly means of all sites together."""
    sums = stays.groupBy("site", F.hour("in_ts").alias("hour")).agg(
        F.sum("dwell_sec").alias("total"), F.count(F.lit(1)).alias("n")
    )
    mean = rounded_ratio(F.col("total"), F.col("n") * 60, 1).alias("dwell_min")
    hourly = sums.groupBy("hour").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    reference = mean_value(hourly.select(mean), "dwell_min")
    return sums.select("site", "hour", mean).withColumn("reference", reference)


def with_site_reference(usage: DataFrame, bucket: str) -> DataFrame:
    """Add the mean count per bucket over all sites, rounded, divided by the number of sites."""
    mean = rounded_units(F.sum("usage_count"), F.count_distinct(bucket))
    reference = usage.agg(rounded_ratio(mean, F.count_distinct("site"), 1).alias("mean")).scalar()
    return usage.withColumn("reference", reference)


def stay_summary(stays: DataFrame) -> DataFrame:
    """Per sensor: stays, dwell minutes and daily counts. Days without a stay do not count."""
    daily = stays.groupBy("sensor", F.to_date("in_ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("dwell_sec").alias("total"),
        F.max("dwell_sec").alias("longest"), F.min("dwell_sec").alias("shortest"),
    )
    return (
        daily.groupBy("sensor")
        .agg(
            F.sum("n").alias("n_stays"), F.sum("total").alias("total"),
            F.max("longest").alias("longest"), F.min("shortest").alias("shortest"),
            F.count(F.lit(1)).alias("days"), F.max("n").alias("daily_max"),
        )
        .select(
            "sensor", "n_stays",
            rounded_ratio(F.col("total"), F.col("n_stays") * 60).alias("dwell_mean_min"),
            rounded_ratio(F.col("longest"), 60).alias("dwell_max_min"),
            rounded_ratio(F.col("shortest"), 60, 1).alias("dwell_min_min"),
            rounded_ratio(F.col("n_stays"), F.col("days")).alias("daily_mean"),
            "daily_max",
        )
    )


def top(report: DataFrame, value: str, k: int = 5) -> DataFrame:
    """The k highest rows; ties go to the sensor name first in order."""
    return report.orderBy(F.col(value).desc(), "sensor").limit(k)


def top_sensors_by_occupancy(cells: DataFrame, k: int = 5) -> DataFrame:
    """Sensors by mean percent over the observed hours. All share the number of hours, so the
    sums rank them; the value is rounded afterwards."""
    hours = cells.agg(F.count_distinct("hour").alias("hours")).scalar()
    sums = cells.groupBy("sensor").agg(F.sum("pct100").alias("pct100"))
    return (
        top(sums, "pct100", k)
        .withColumn("hours", hours)
        .select(
            "sensor",
            rounded_ratio(F.col("pct100"), F.col("hours") * 100, 1).alias("occupancy_pct"),
        )
    )


def _above_mean(value: Column) -> Column:
    num, den = PEAK_FACTOR
    w = _all_rows()
    return value * F.count(F.lit(1)).over(w) * den > F.sum(value).over(w) * num


def peak_usage(stays: DataFrame) -> DataFrame:
    """First and last hour of day with more than 1.5 times the mean count; NULL if none."""
    usage = usage_by_grain(stays, "hour")
    marked = usage.withColumn("busy", _above_mean(F.col("usage_count")))
    hour = F.when(F.col("busy"), F.col("hour"))
    return marked.agg(
        rounded_ratio(F.sum("usage_count"), F.count(F.lit(1))).alias("mean_count"),
        F.max("usage_count").alias("max_count"),
        F.min(hour).alias("peak_start"), F.max(hour).alias("peak_end"),
    )


def peak_dwell(stays: DataFrame) -> DataFrame:
    """Hours of day with more than 1.5 times the mean dwell. When the longest dwell falls in the
    small hours, the peak runs from midnight to the last such hour among them."""
    hourly = (
        stays.groupBy(F.hour("in_ts").alias("hour"))
        .agg(F.sum("dwell_sec").alias("total"), F.count(F.lit(1)).alias("n"))
        .select("hour", rounded_units(F.col("total"), F.col("n") * 60, 1).alias("tenths"))
    )
    marked = hourly.withColumn("long", _above_mean(F.col("tenths")))
    hour = F.when(F.col("long"), F.col("hour"))
    stats = marked.agg(
        rounded_units(F.sum("tenths"), F.count(F.lit(1))).alias("mean"),
        F.max("tenths").alias("max"),
        F.min_by("hour", F.struct(-F.col("tenths"), F.col("hour"))).alias("longest_hour"),
        F.min(hour).alias("first"), F.max(hour).alias("last"),
        F.max(F.when(F.col("hour") <= NIGHT_END_HOUR, hour)).alias("last_night"),
    )
    night = F.col("longest_hour") <= NIGHT_END_HOUR
    return stats.select(
        (F.col("mean") / F.lit(10.0)).alias("mean_dwell_min"),
        (F.col("max") / F.lit(10.0)).alias("max_dwell_min"),
        "longest_hour",
        F.when(night, 0).otherwise(F.col("first")).alias("peak_start"),
        F.when(night, F.col("last_night")).otherwise(F.col("last")).alias("peak_end"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
