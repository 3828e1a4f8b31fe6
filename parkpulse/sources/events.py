"""Sensor messages derived from an `events` table (see FIXTURES.md for the recipe)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parkpulse.functions import vocabulary as V

SHIFT_DAYS = 715


def messages_from_events(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Raw messages (row_id, sensor, payload, send_ts) with the payload as devices send it.

    One task reads a row group, however large it is, and would also do all that follows up to the next
    shuffle. With `spread` the narrow events are dealt to all tasks first, by all of their columns.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    if spread:
        events = events.repartition(*events.columns)
    k = F.get_json_object("props", "$.k").cast("int")
    error = F.col("event_type") == "error"
    site = F.get(F.array(F.lit("대신"), F.lit("옥천"), F.lit("영천")), F.col("user_id") % 3)
    detector = (
        F.when(error & (k == 99), V.BOOT)
        .when(F.col("event_type").isin("view", "click"), V.PARK)
        .when(F.col("event_type").isin("signup", "purchase"), V.DEPART)
        .when(F.col("event_id") % 2 == 0, V.PARK)
        .otherwise(V.DEPART)
    )
    action = (
        F.when(~error, V.EVENT)
        .when(k < 50, V.PERIODIC)
        .when(k < 70, "LoRa 수신오류")
        .when(k < 85, "레이더 고장")
        .when(k < 92, "오류")
        .when(k < 96, "2.0")
        .when(k < 99, "3.0")
        .otherwise(V.BOOT_ACTION)
    )
    fault = F.when(k % 25 == 0, V.FAULT_RESET).otherwise("0.0")
    payload = F.concat(
        F.lit("장치구분: 주차검지센서, 검지기: "), detector,
        F.lit(", 배터리: 3.6, 장애: "), fault,
        F.lit(", RSSI: -"), (k + 60).cast("string"),
        F.lit(", SNR: "), (k % 12).cast("string"),
        F.lit(", 동작: "), action,
    )
    # Dropping the fraction on the text keeps the result independent of the session zone.
    sent = F.col("ts").cast("timestamp_ntz") - F.expr(f"INTERVAL {SHIFT_DAYS} DAYS")
    digits = F.col("user_id").cast("string")
    # At least five digits; `lpad` would also cut longer numbers.
    number = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 5 - F.length(digits))), digits)
    return events.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("주차센서_"), site, F.lit("졸음쉼터_#"), number).alias("sensor"),
        payload.alias("payload"),
        F.substring(sent.cast("string"), 1, 19).alias("send_ts"),
    )
