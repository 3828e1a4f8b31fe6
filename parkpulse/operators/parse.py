"""Raw messages to typed messages: label stripping, field split, recodes, cleanup."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkpulse.functions import vocabulary as V

SENSOR_STYLES = ("full", "short", "charclass")
NAME_END = 2**31 - 1


def clean_sensor(sensor: Column, style: str = "short") -> Column:
    """Readable sensor name.

    full       drop the leading device prefix: 대신졸음쉼터_#01
    short      also drop the rest-area word and the character after it: 대신#01
    charclass  drop every character of either word, wherever it stands: 대신#01
    """
    if style == "charclass":
        return F.translate(sensor, V.NAME_CHARACTERS, "")
    prefixed = sensor.startswith(V.DEVICE_PREFIX)
    full = F.when(prefixed, F.substring(sensor, len(V.DEVICE_PREFIX) + 1, NAME_END)).otherwise(sensor)
    if style == "full":
        return full
    if style == "short":
        return F.regexp_replace(full, f"^(.*?){V.REST_AREA}.", "$1")
    raise ValueError(f"sensor style must be one of {SENSOR_STYLES}")


def with_names(raw: DataFrame, style: str) -> DataFrame:
    """Three message columns and the row id, with the sensor name cleaned and time typed."""
    return raw.select(
        "row_id",
        clean_sensor(F.col("sensor"), style).alias("sensor"),
        F.col("send_ts").try_cast("timestamp_ntz").alias("ts"),
        "payload",
    )


def site_of(sensor: Column) -> Column:
    """What stands before the rest-area word, or before the number in a cleaned name."""
    return F.get(F.split(sensor, f"{V.REST_AREA}|#", 2), F.lit(0))


def _split_once(named: DataFrame, limit: int) -> DataFrame:
    """Messages with the payload split into `parts`, each value computed once per row.

    Catalyst pushes filters below a projection and repeats its expressions in them, and filters do
    not share common parts; it does not push through a generator.
    """
    parts = F.split(F.regexp_replace("payload", V.LABEL_PATTERN, ""), ",", limit)
    row = F.struct("row_id", "sensor", "ts", parts.alias("parts"))
    return named.select(F.inline(F.array(row)))


def _fields() -> dict[str, Column]:
    return {name: F.get("parts", F.lit(i)) for i, name in enumerate(V.PAYLOAD_FIELDS)}


def recode_action(action: Column) -> Column:
    """Spell out the coded LoRa resets."""
    return (
        F.when(action.isin(*V.LORA_RESET_CODES), V.LORA_RESET)
        .when(action == V.LORA_SELF_RESET_CODE, V.LORA_SELF_RESET)
        .otherwise(action)
    )


def action_category(action: Column) -> Column:
    return (
        F.when(action.isin(*V.COMM_CODES) | action.contains("LoRa"), V.COMM_ERROR)
        .when(action.contains("고장"), V.SENSOR_ERROR)
        .when(action.contains("주기"), V.PERIODIC)
        .otherwise(V.NORMAL)
    )


def parse_guarded(named: DataFrame) -> DataFrame:
    """Typed messages; a surplus of commas stays in the action, incomplete messages go.

    A field counts as missing when the payload is too short for it, or when a numeric field is
    blank. A numeric field with other text keeps its message and becomes NULL.
    """
    field = _fields()
    complete = _split_once(named, len(V.PAYLOAD_FIELDS)).where(
        (F.size("parts") == len(V.PAYLOAD_FIELDS))
        & reduce(and_, [F.trim(field[n]) != "" for n in V.NUMERIC_FIELDS])
        & F.col("sensor").isNotNull()
        & F.col("ts").isNotNull()
    )
    fault = F.when(field["fault"] == V.FAULT_RESET, V.FAULT_RESET_LABEL)
    typed = field | {n: field[n].try_cast("double") for n in V.TYPED_FIELDS}
    typed |= {"fault": fault.otherwise(field["fault"]), "action": recode_action(field["action"])}
    return complete.select("row_id", "sensor", "ts", *[c.alias(n) for n, c in typed.items()])


def parse_precedence(named: DataFrame) -> DataFrame:
    """Every message kept; short payloads leave NULL fields; the action becomes a category
    except on boot messages and where the detector is missing."""
    field = _fields()
    detector = F.replace(field["detector"], F.lit("차량"), F.lit(""))
    keep_action = field["detector"].isNull() | (detector == V.BOOT)
    return _split_once(named, -1).select(
        "row_id", "sensor", "ts",
        detector.alias("detector"),
        field["fault"].alias("fault"),
        F.when(keep_action, field["action"])
        .otherwise(action_category(field["action"])).alias("action"),
    )


def drop_duplicates(messages: DataFrame) -> DataFrame:
    """Exact copies collapse to the first of them; the row id is not part of a message."""
    message = [c for c in messages.columns if c != "row_id"]
    return messages.groupBy(*message).agg(F.min("row_id").alias("row_id"))
