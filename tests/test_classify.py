"""One small table per rule of either classifier."""

from helpers import codes, depart, park, raw_messages

from pyspark.sql import functions as F

from parkpulse.functions import vocabulary as V
from parkpulse.plans import pipeline as P

A, B, C, D = (f"2022-03-01 1{h}:00:00" for h in range(4))
ERR = "LoRa 수신오류"


def guarded(spark, rows, **options):
    return codes(P.guarded(raw_messages(spark, rows), **options))


def precedence(spark, rows):
    return codes(P.precedence(raw_messages(spark, rows)))


def test_pair_is_normal(spark):
    assert guarded(spark, [park(A), depart(B)]) == [0, 0]
    assert precedence(spark, [park(A), depart(B)]) == [0, 0]


def test_after_report_only_when_asked(spark):
    rows = [park(A), depart(B), depart(C, V.PERIODIC), park(D)]
    assert guarded(spark, rows) == [0, 0, 1, 3]
    assert guarded(spark, rows, post_report=True) == [0, 0, 1, 4]


def test_after_report_does_not_leak_to_the_next_sensor(spark):
    rows = [park(A, V.PERIODIC, "주차센서_대신졸음쉼터_#01"),
            park(B, V.EVENT, "주차센서_대신졸음쉼터_#02"),
            depart(C, V.EVENT, "주차센서_대신졸음쉼터_#02")]
    assert guarded(spark, rows, post_report=True) == [1, 0, 0]


def test_park_before_report_or_error(spark):
    assert guarded(spark, [park(A), depart(B, V.PERIODIC), park(C), depart(D)]) == [3, 1, 0, 0]
    assert guarded(spark, [park(A), depart(B, ERR)])[0] == 3


def test_park_twice(spark):
    assert guarded(spark, [park(A), park(B), depart(C)]) == [3, 0, 0]
    assert precedence(spark, [park(A), park(B), depart(C)]) == [3, 0, 0]


def test_depart_twice(spark):
    assert guarded(spark, [park(A), depart(B), depart(C)]) == [0, 0, 3]
    assert precedence(spark, [park(A), depart(B), depart(C)]) == [0, 0, 3]


def test_month_change_overrides_every_base_code(spark):
    last, first = "2022-01-31 23:00:00", "2022-02-01 01:00:00"
    assert guarded(spark, [park(last), depart(first)]) == [3, 3]
    assert guarded(spark, [park(last, V.PERIODIC), depart(first, ERR)]) == [3, 3]


def test_month_change_loses_to_after_report(spark):
    last, first = "2022-01-31 23:00:00", "2022-02-01 01:00:00"
    rows = [park(last, V.PERIODIC), depart(first, ERR)]
    assert guarded(spark, rows, post_report=True) == [3, 4]


def test_first_departure_and_last_arrival(spark):
    assert guarded(spark, [depart(A), park(B)]) == [3, 3]
    assert precedence(spark, [depart(A), park(B)]) == [3, 3]
    assert guarded(spark, [park(A)]) == [3]
    assert precedence(spark, [depart(A)]) == [3]


def test_error_codes_survive_the_guard(spark):
    rows = [park(A, ERR), park(B, V.PERIODIC), park(C), depart(D)]
    assert guarded(spark, rows) == [2, 1, 0, 0]


def test_the_two_rule_sets_disagree_on_an_unpaired_error(spark):
    rows = [park(A, ERR), park(B), depart(C)]
    assert guarded(spark, rows) == [2, 0, 0]
    assert precedence(spark, rows) == [3, 0, 0]


def test_precedence_categories(spark):
    rows = [park(A, ERR), depart(B, V.PERIODIC), park(C, "레이더 고장"), depart(D, V.EVENT)]
    assert precedence(spark, rows) == [2, 1, 2, 0]


def test_boot_keeps_its_action(spark):
    boot = (B, V.BOOT, V.BOOT_ACTION)
    coded = P.precedence(raw_messages(spark, [park(A), boot, depart(C)]))
    assert codes(coded) == [3, 0, 3]
    assert V.BOOT_ACTION in [r.action for r in coded.collect()]
    assert guarded(spark, [park(A), boot, depart(C)]) == [3, 2, 0]


def test_missing_neighbour_detector_matches_no_rule(spark):
    raw = raw_messages(spark, [park(A), park(B), depart(C)])
    short = raw.withColumn(
        "payload",
        F.expr(
            "CASE WHEN row_id = 1 THEN '장치구분: 주차검지센서' ELSE payload END"
        ),
    )
    assert codes(P.precedence(short)) == [0, 0, 0]


def test_sensor_without_name_has_no_neighbours(spark):
    raw = raw_messages(spark, [park(A), park(B)]).selectExpr(
        "row_id", "CAST(NULL AS STRING) AS sensor", "payload", "send_ts"
    )
    assert codes(P.precedence(raw)) == [0, 0]
    assert P.precedence_stays(raw).count() == 0
    assert P.guarded(raw).count() == 0
