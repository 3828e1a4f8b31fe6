"""Error reports over coded messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkpulse.functions import vocabulary as V
from parkpulse.functions.numbers import ratio
from parkpulse.operators.parse import site_of

REPORT_KEYS = ("sensor", "site")


def report_key(by: str) -> Column:
    """Sensor or site, without the rest-area word."""
    if by not in REPORT_KEYS:
        raise ValueError(f"by must be one of {REPORT_KEYS}")
    key = F.col("sensor") if by == "sensor" else site_of(F.col("sensor"))
    return F.replace(key, F.lit(V.REST_AREA), F.lit(""))


def _has(code: int) -> Column:
    return F.col("status_code") == code


def error_summary(coded: DataFrame, by: str | None = None, post_report: bool = False) -> DataFrame:
    """Counts per message class from guarded codes. The total is the sum of the columns, so it
    may differ from the number of messages. Without `by`, the key is the sensor as it is."""
    action = F.col("action")
    counts = {"n_normal": (action == V.EVENT) & _has(V.OK), "n_periodic": _has(V.REPORT)}
    if post_report:
        counts["n_post_report"] = _has(V.AFTER_REPORT)
    counts |= {
        "n_comm": action.startswith("LoRa") & _has(V.DEVICE_ERROR),
        "n_sensor": action.startswith("레이더") & _has(V.DEVICE_ERROR),
        "n_boot": action == V.BOOT_ACTION,
        "n_sequence": _has(V.SEQUENCE_ERROR),
    }
    key, name = (report_key(by), by) if by else (F.col("sensor"), "sensor")
    total = sum((F.col(c) for c in counts), F.lit(0).cast("bigint"))
    return (
        coded.groupBy(key.alias(name))
        .agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
        .withColumn("n_total", total)
    )


def code_counts(coded: DataFrame, *keys: Column | str) -> DataFrame:
    """Messages per code 0 to 3 for any keys."""
    return coded.groupBy(*keys).agg(
        F.count_if(_has(V.OK)).alias("n_normal"),
        F.count_if(_has(V.REPORT)).alias("n_periodic"),
        F.count_if(_has(V.DEVICE_ERROR)).alias("n_comm_device"),
        F.count_if(_has(V.SEQUENCE_ERROR)).alias("n_sequence"),
    )


def distinct_coded(coded: DataFrame) -> DataFrame:
    return coded.select("sensor", "detector", "ts", "status_code").dropDuplicates()


def sequence_errors_daily(coded: DataFrame) -> DataFrame:
    return (
        coded.where(_has(V.SEQUENCE_ERROR))
        .groupBy(F.to_date("ts").alias("date"), "sensor")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _sequence_rate(among: Column | None = None) -> Column:
    among = F.lit(True) if among is None else among
    return ratio(F.count_if(among & _has(V.SEQUENCE_ERROR)), F.nullif(F.count_if(among), F.lit(0)))


def sequence_error_rate(coded: DataFrame) -> DataFrame:
    """Share of sequence errors per site and month."""
    return coded.groupBy(
        site_of(F.col("sensor")).alias("site"), F.month("ts").alias("month")
    ).agg(_sequence_rate().alias("error_rate"))


def selected_error_rate(coded: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Share of sequence errors per month for chosen sensors."""
    return (
        coded.where(F.col("sensor").isin(*sensors))
        .groupBy("sensor", F.month("ts").alias("month"))
        .agg(_sequence_rate().alias("error_rate"))
    )


def error_rate_wide(coded: DataFrame, sites: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """One row per month, a rate column per site and per chosen sensor, in a single pass."""
    site = site_of(F.col("sensor"))
    columns = [_sequence_rate(site == s).alias(s) for s in sites]
    columns += [_sequence_rate(F.col("sensor") == s).alias(s) for s in sensors]
    return coded.groupBy(F.month("ts").alias("month")).agg(*columns)
