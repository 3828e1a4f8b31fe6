"""Status codes: 0 normal, 1 periodic report, 2 device or link error, 3 out of sequence,
4 first message after a periodic report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkpulse.functions import vocabulary as V
from parkpulse.operators.neighbours import with_neighbours


def base_code(action: Column) -> Column:
    return (
        F.when(action == V.EVENT, V.OK).when(action == V.PERIODIC, V.REPORT)
        .otherwise(V.DEVICE_ERROR)
    )


def classify_guarded(
    messages: DataFrame, post_report: bool = False, keep_next: bool = False
) -> DataFrame:
    """Sequence checks apply to messages that are normal by their action; a month change
    between neighbours overrides every base code. `post_report` adds code 4. `keep_next` keeps the
    struct `next` of the following message."""
    based = messages.withColumn("base", base_code(F.col("action")))
    both = with_neighbours(based, ("ts", "detector", "base"))
    normal = F.col("base") == V.OK
    park, depart = F.col("detector") == V.PARK, F.col("detector") == V.DEPART
    month = F.month("ts")
    before_error = park & (F.col("next.base") != V.OK) & normal
    park_twice = park & (F.col("next.detector") == V.PARK) & normal
    depart_twice = depart & (F.col("prev.detector") == V.DEPART) & normal
    month_change = (park & (month != F.month("next.ts"))) | (
        depart & (month != F.month("prev.ts"))
    )
    unpaired = normal & (
        (depart & F.col("prev").isNull()) | (park & F.col("next").isNull())
    )
    sequence = before_error | park_twice | depart_twice | month_change | unpaired
    code = F.when(sequence, V.SEQUENCE_ERROR).otherwise(F.col("base"))
    if post_report:
        code = F.when(F.col("prev.base") == V.REPORT, V.AFTER_REPORT).otherwise(code)
    coded = both.withColumn("status_code", code)
    return coded.drop("base", "prev") if keep_next else coded.drop("base", "prev", "next")


def classify_precedence(messages: DataFrame) -> DataFrame:
    """Sequence checks come before the action category and ignore it."""
    both = with_neighbours(messages, ("detector",))
    park, depart = F.col("detector") == V.PARK_SHORT, F.col("detector") == V.DEPART_SHORT
    no_departure = park & (
        F.col("next").isNull() | (F.col("next.detector") != V.DEPART_SHORT)
    )
    no_arrival = depart & (
        F.col("prev").isNull() | (F.col("prev.detector") != V.PARK_SHORT)
    )
    # A message without a sensor name has no neighbours to compare with.
    sequence = F.col("sensor").isNotNull() & (no_departure | no_arrival)
    code = (
        F.when(sequence, V.SEQUENCE_ERROR)
        .when(F.col("action").contains("오류"), V.DEVICE_ERROR)
        .when(F.col("action") == V.PERIODIC, V.REPORT)
        .otherwise(V.OK)
    )
    return both.withColumn("status_code", code).drop("prev", "next")


def status_label(code: Column) -> Column:
    label = F.when(code == V.SEQUENCE_ERROR, V.STATUS_LABELS[V.SEQUENCE_ERROR])
    label = label.when(code == V.DEVICE_ERROR, V.STATUS_LABELS[V.DEVICE_ERROR])
    label = label.when(code == V.REPORT, V.STATUS_LABELS[V.REPORT])
    return label.otherwise(V.STATUS_LABELS[V.OK])
