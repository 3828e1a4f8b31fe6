"""One dominant sensor, copies and slices: same answers, and no task that holds a whole sensor."""

import pytest
from helpers import RAW_SCHEMA, TESTDATA, park, payload, raw_messages, rows
from pyspark.sql import functions as F

from parkpulse.functions import vocabulary as V
from parkpulse.operators import neighbours as N
from parkpulse.operators.parse import with_names
from parkpulse.plans import pipeline as P
from parkpulse.sources.events import messages_from_events

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """A third and more of all rows come from one sensor."""
    raw = messages_from_events(spark, SF)
    hot = F.when(F.col("row_id") % 2 == 0, F.lit("주차센서_옥천졸음쉼터_#00001"))
    return raw.withColumn("sensor", F.coalesce(hot, "sensor"))


PLANS = [P.guarded, P.precedence, P.guarded_stays, P.precedence_stays]


@pytest.mark.parametrize("size", [1, 7, 40, 200])
@pytest.mark.parametrize("plan", PLANS)
def test_slices_change_nothing(skewed, plan, size):
    whole = plan(skewed)
    cut = plan(skewed, slice_rows=size)
    assert cut.columns == whole.columns and N.SLICE not in whole.columns
    assert rows(cut) == rows(whole)


@pytest.mark.parametrize("plan", PLANS)
def test_same_for_any_number_of_partitions(spark, skewed, plan):
    expected = rows(plan(skewed))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows(plan(skewed.coalesce(1), slice_rows=25)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_job_before_the_action(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "plans only")
    try:
        for plan in PLANS:
            plan(skewed, slice_rows=10)
        assert not tracker.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_post_report_across_slices(skewed):
    whole = P.guarded(skewed, post_report=True)
    cut = P.guarded(skewed, post_report=True, slice_rows=5)
    assert rows(cut.select(*whole.columns)) == rows(whole)


@pytest.mark.parametrize("slices", [1, 3])
def test_few_slices_hold_more_rows(skewed, monkeypatch, slices):
    """The number of places to cut is bounded; the answers are the same."""
    monkeypatch.setattr(N, "SLICES", slices)
    assert rows(P.guarded_stays(skewed, slice_rows=1)) == rows(P.guarded_stays(skewed))
    cut = P._placed_messages(skewed, "short", 1)
    assert cut.where("slice > 0").select("slice").distinct().count() <= 2 * slices + 2


def test_slices_are_even_and_ordered(skewed):
    parsed = N.without_ghosts(P._placed_messages(skewed, "short", 50))
    hot = parsed.where("slice > 0 AND sensor = '옥천#00001'")
    total = hot.count()
    sizes = hot.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    ).orderBy("slice").collect()
    assert len(sizes) >= total // 100
    assert max(r.n for r in sizes) <= 150
    assert all(a.hi <= b.lo for a, b in zip(sizes, sizes[1:]))


def pile(spark, n=400):
    """Copies share sensor and time; only the row id tells them apart."""
    same = [(i, "주차센서_대신졸음쉼터_#01", payload(V.PARK, V.EVENT), "2022-03-01 10:00:00") for i in range(n)]
    return spark.createDataFrame(same, RAW_SCHEMA)


def test_pile_of_equal_messages_splits(spark):
    raw = pile(spark)
    whole = P.precedence(raw)
    cut = P._precedence(raw, slice_rows=50)
    assert rows(cut.select(*whole.columns)) == rows(whole)
    assert cut.groupBy("slice").count().agg(F.max("count")).first()[0] <= 150


def test_later_copies_are_dropped_where_they_are_read(spark):
    """Of a pile only what comes before its first sampled copy is shuffled, and its first copy stays."""
    others = raw_messages(spark, [park("2022-03-01 10:00:00", f"other {i}") for i in range(30)])
    raw = pile(spark).withColumn("row_id", F.col("row_id") + 1000).unionByName(others)
    named = with_names(raw, "short")
    kept = N.without_later_copies(named, N.cutting(named, 50, copies=True))
    assert kept.count() < 100
    assert kept.where("row_id >= 1000").agg(F.min("row_id")).first()[0] == 1000
    assert kept.where("row_id < 1000").count() == 30
    assert rows(P.guarded_messages(raw, slice_rows=50)) == rows(P.guarded_messages(raw))


def test_nulls_and_empty_names_stand_apart(spark):
    raw = raw_messages(spark, [
        park(f"2022-03-01 10:{i % 60:02d}:00", V.EVENT, name) for i in range(300) for name in (None, "", "주차센서_대신졸음쉼터_#01")
    ] + [park("no time"), park("2022-03-01 11:00:00")])
    for plan in (P.guarded, P.precedence):
        assert rows(plan(raw, slice_rows=20)) == rows(plan(raw))
    assert P.guarded_stays(raw.limit(0), slice_rows=1).count() == 0


def test_order_does_not_depend_on_partitions(spark):
    raw = messages_from_events(spark, SF)
    expected = rows(P.guarded_stays(raw))
    for n in (1, 3, 17):
        assert rows(P.guarded_stays(raw.repartition(n))) == expected


def test_ties_follow_the_row_id(spark):
    raw = raw_messages(spark, [
        park("2022-03-01 10:00:00"),
        ("2022-03-01 10:00:00", V.DEPART, V.EVENT),
        park("2022-03-01 11:00:00"),
        ("2022-03-01 12:00:00", V.DEPART, V.EVENT),
    ])
    assert [r.dwell_sec for r in P.guarded_stays(raw).orderBy("in_ts").collect()] == [0, 3600]
