"""Stays into hours, and the three ways of averaging them."""

from datetime import datetime, timedelta

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parkpulse.operators import occupancy as O

STAY_SCHEMA = (
    "sensor string, site string, in_ts timestamp_ntz, out_ts timestamp_ntz, dwell_sec bigint"
)


def stays_of(spark, *spans, sensor="대신#01"):
    data = []
    for span in spans:
        name = span[2] if len(span) > 2 else sensor
        start, end = (datetime.fromisoformat(t) for t in span[:2])
        data.append((name, name[:2], start, end, int((end - start).total_seconds())))
    return spark.createDataFrame(data, STAY_SCHEMA)


def hours_of(df):
    return [
        (r.hour.strftime("%d %H"), r.occupied_sec)
        for r in df.orderBy("sensor", "hour").collect()
    ]


@pytest.mark.parametrize("start,end,expected", [
    ("2022-03-01 10:10:00", "2022-03-01 10:40:00", [("01 10", 1800)]),
    ("2022-03-01 10:30:00", "2022-03-01 11:15:00", [("01 10", 1800), ("01 11", 900)]),
    ("2022-03-01 10:00:00", "2022-03-01 12:30:00",
     [("01 10", 3600), ("01 11", 3600), ("01 12", 1800)]),
    ("2022-03-01 10:30:00", "2022-03-01 11:00:00", [("01 10", 1800), ("01 11", 0)]),
    ("2022-03-01 23:59:59", "2022-03-02 00:00:01", [("01 23", 1), ("02 00", 1)]),
    ("2022-02-28 23:00:00", "2022-03-01 00:00:00", [("28 23", 3600), ("01 00", 0)]),
    ("2022-03-01 10:00:00", "2022-03-01 10:00:00", [("01 10", 0)]),
])
def test_hours_of_a_stay(spark, start, end, expected):
    assert hours_of(O.hourly_occupancy(stays_of(spark, (start, end)))) == expected


def test_stays_in_one_hour_add_up(spark):
    stays = stays_of(spark, ("2022-03-01 10:00:00", "2022-03-01 10:10:00"),
                     ("2022-03-01 10:20:00", "2022-03-01 10:21:00"))
    assert hours_of(O.hourly_occupancy(stays)) == [("01 10", 660)]


instant = st.integers(0, 40 * 86_400).map(lambda s: datetime(2022, 1, 10) + timedelta(seconds=s))


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(instant, st.integers(0, 200_000)), min_size=1, max_size=40))
def test_expansion_properties(spark, spans):
    data = [(f"대신#{i:02d}", "대신", a, a + timedelta(seconds=d), d)
            for i, (a, d) in enumerate(spans)]
    stays = spark.createDataFrame(data, STAY_SCHEMA)
    hours = O.stay_hours(stays).groupBy("sensor").agg(
        F.sum("occupied_sec").alias("total"), F.count("*").alias("n"),
        F.min("occupied_sec").alias("low"), F.max("occupied_sec").alias("high"),
    )
    got = {r.sensor: r for r in hours.collect()}
    for name, _, a, b, dwell in data:
        floor = [t.replace(minute=0, second=0) for t in (a, b)]
        assert got[name].total == dwell
        assert got[name].n == (floor[1] - floor[0]).total_seconds() / 3600 + 1
        assert got[name].low >= 0 and got[name].high <= 3600


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(instant, st.integers(0, 300_000), st.integers(0, 2)), min_size=1, max_size=30))
def test_runs_of_overlapping_stays_are_the_sums_of_their_hours(spark, spans):
    data = [(f"대신#{s:02d}", "대신", a, a + timedelta(seconds=d), d) for a, d, s in spans]
    stays = spark.createDataFrame(data, STAY_SCHEMA)
    hours = O.stay_hours(stays).groupBy("sensor", "hour").agg(F.sum("occupied_sec").alias("occupied_sec"))
    cells = O.hourly_occupancy(stays)
    assert rows(cells.select("sensor", "hour", "occupied_sec")) == rows(hours)
    days = ("2022-01-12", "2022-01-20")
    inside = cells.where((F.to_date("hour") >= days[0]) & (F.to_date("hour") <= days[1]))
    assert rows(O.cells_in_days(stays, *days)) == rows(inside)
    runs = O.hour_runs(stays)
    assert runs.count() <= 4 * len(spans)
    for part in ("hour", "weekday"):
        for group in (None, "sensor"):
            for d in (None, days):
                assert rows(O.observed_mean(runs, part, group, d)) == rows(O.observed_mean(cells, part, group, d))
    by_hour = hours.groupBy("sensor", F.hour("hour").alias("hour")).agg(F.sum("occupied_sec").alias("occupied_sec"))
    closed = O.seconds_by_hour_of_day(stays).groupBy("sensor", "hour").agg(F.sum("occupied_sec").alias("occupied_sec"))
    assert rows(closed.where("occupied_sec > 0")) == rows(by_hour.where("occupied_sec > 0"))


def test_a_stay_of_ten_years_costs_as_much_as_a_short_one(spark):
    stays = stays_of(spark, ("2012-03-01 10:30:00", "2022-03-01 11:15:00"), ("2012-03-05 10:00:00", "2012-03-05 10:20:00", "옥천#02"))
    runs = O.hour_runs(stays)
    assert sorted((r.sensor, r.hours, r.occupied_sec) for r in runs.collect()) == [
        ("대신#01", 1, 900), ("대신#01", 1, 1800), ("대신#01", 3652 * 24, 3600), ("옥천#02", 1, 1200),
    ]
    assert O.seconds_by_hour_of_day(stays).count() == 24 + 1
    by_hour = {r.hour: r.occupied_sec for r in O.seconds_by_hour_of_day(stays.where("sensor = '대신#01'")).collect()}
    assert by_hour[9] == 3652 * 3600 and by_hour[10] == 3652 * 3600 + 1800 and by_hour[11] == 3652 * 3600 + 900
    means = by(O.observed_mean(runs, "hour"), "hour")
    assert means[9] == 50.0 and len(means) == 24
    assert by(O.observed_mean(runs, "weekday"), "weekday")[0] == 50.0


def test_zone_does_not_matter(spark):
    stays = stays_of(spark, ("2022-03-13 01:30:00", "2022-03-13 03:30:00"))
    expected = hours_of(O.hourly_occupancy(stays))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert hours_of(O.hourly_occupancy(stays)) == expected
        assert expected == [("13 01", 1800), ("13 02", 3600), ("13 03", 1800)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture(scope="module")
def two_sensors(spark):
    """대신#01 full at 10 and half at 12, 옥천#02 quarter at 10; the hour 11 is free."""
    return stays_of(
        spark,
        ("2022-03-01 10:00:00", "2022-03-01 10:59:59"),
        ("2022-03-01 12:00:00", "2022-03-01 12:30:00"),
        ("2022-03-01 10:10:00", "2022-03-01 10:25:00", "옥천#02"),
    )


def by(df, key, value="occupancy_pct"):
    return {r[key]: r[value] for r in df.collect()}


def test_observed_counts_every_sensor_at_observed_hours(spark, two_sensors):
    cells = O.hourly_occupancy(two_sensors)
    assert by(O.observed_mean(cells, "hour"), "hour") == {10: 62.5, 12: 25.0}
    assert by(O.observed_mean(cells, "weekday"), "weekday") == {1: 43.7}
    sites = O.observed_mean(cells, "weekday", "site")
    assert by(sites, "site") == {"대신": 75.0, "옥천": 12.5}
    heat = {(r.sensor, r.hour): r.occupancy_pct
            for r in O.observed_mean(cells, "hour", "sensor").collect()}
    assert heat == {("대신#01", 10): 100.0, ("대신#01", 12): 50.0,
                    ("옥천#02", 10): 25.0, ("옥천#02", 12): 0.0}


def test_sparse_counts_own_cells(spark, two_sensors):
    cells = O.hourly_occupancy(two_sensors)
    sites = O.sparse_mean(cells, {"site": F.col("site"), "date": F.to_date("hour")})
    assert by(sites, "site") == {"대신": pytest.approx(74.985), "옥천": 25.0}
    overall = O.mean_over_sites(sites, ["date"]).first().occupancy_pct
    assert overall == pytest.approx(49.9925)


def test_grid_counts_every_hour_and_every_sensor(spark, two_sensors):
    sensors = spark.createDataFrame([("대신#01",), ("옥천#02",), ("영천#03",)], "sensor string")
    dense = O.dense_grid(sensors, two_sensors)
    # 10:00 to 12:30 and one hour more: 10, 11, 12, 13.
    assert dense.count() == 3 * 4
    assert dense.agg(F.sum("occupied_sec")).first()[0] == 3599 + 1800 + 900
    profile = {(r.sensor, r.hour): r.fraction
               for r in O.hour_profile(sensors, two_sensors).collect()}
    assert profile["대신#01", 12] == 0.5
    assert profile["영천#03", 11] == 0.0
    assert profile["옥천#02", 9] is None
    stats = {r.sensor: r for r in O.column_summary(sensors, two_sensors).collect()}
    assert stats["옥천#02"].mean == 900 / (4 * 3600)
    assert (stats["영천#03"].minimum, stats["영천#03"].maximum) == (0.0, 0.0)
    assert (stats["대신#01"].median, stats["대신#01"].q3) == (0.25, round((3 * 0.5 + 3599 / 3600) / 4, 6))


def test_range_keeps_all_sensors_but_only_its_hours(spark):
    stays = stays_of(
        spark, ("2022-03-01 23:30:00", "2022-03-02 00:30:00"),
        ("2022-03-05 10:00:00", "2022-03-05 11:00:00", "옥천#02"),
    )
    cells = O.hourly_occupancy(stays)
    day = ("2022-03-02", "2022-03-02")
    assert by(O.observed_mean(cells, "hour", days=day), "hour") == {0: 25.0}
    assert hours_of(O.cells_in_days(stays, *day)) == [("02 00", 1800)]


def test_wide_and_back(spark, two_sensors):
    cells = O.hourly_occupancy(two_sensors)
    wide = O.to_wide(cells, ["대신#01", "옥천#02", "없음#03"])
    assert wide.columns == ["hour", "대신#01", "옥천#02", "없음#03"]
    assert [tuple(r)[1:] for r in wide.orderBy("hour").collect()] == [(99.97, 25.0, 0.0), (50.0, 0.0, 0.0)]
    assert O.from_wide(wide, "hour", "sensor", "occupancy_pct").count() == 6
    only = O.to_wide(cells, ["옥천#02"])
    assert only.count() == 2  # the hours observed for any sensor
