"""Physical plans: how often the messages are shuffled, and that nothing runs in one task."""

import re

import pytest
from helpers import TESTDATA, plan_nodes
from pyspark.sql import functions as F

from parkpulse.operators import neighbours as N
from parkpulse.operators import occupancy as O
from parkpulse.plans import pipeline as P
from parkpulse.plans.catalog import catalog
from parkpulse.sources.events import messages_from_events

SF = f"{TESTDATA}/sf0.001"


def plan_of(df):
    """The plan without its scalars, which are read before it runs."""
    return "\n".join(description for _, description in plan_nodes(df))


def exchanges(df):
    return [re.search(r"Exchange (\w+)", d)[1] for name, d in plan_nodes(df) if name == "Exchange"]


def count_of(df, kind):
    df.collect()
    return sum(name == kind for name, _ in plan_nodes(df, subqueries=True))


@pytest.fixture(scope="module")
def raw(spark):
    return messages_from_events(spark, SF)


@pytest.mark.parametrize("stays,windows", [(P.guarded_stays, 1), (P.precedence_stays, 2)])
def test_one_shuffle_from_messages_to_stays(raw, stays, windows):
    df = stays(raw)
    df.collect()
    assert exchanges(df) == ["hashpartitioning"]
    assert [name for name, _ in plan_nodes(df)].count("Sort") == 1
    assert [name for name, _ in plan_nodes(df)].count("Window") == windows


def test_ends_of_stays_are_added_up_before_they_move(raw):
    df = P.guarded_cells(raw)
    assert exchanges(df) == ["hashpartitioning"] * 3
    assert "partial_sum(opens" in plan_of(df)


def test_site_report_adds_only_its_own_shuffle(raw):
    df = P.guarded_stays(raw).groupBy("site").agg(F.sum("dwell_sec"))
    assert exchanges(df) == ["hashpartitioning"] * 2


WITH_REFERENCE = {
    "usage_by_hour": 2, "usage_by_site_hour": 1, "usage_by_weekday": 2, "usage_by_site_weekday": 1,
    "dwell_by_hour": 2, "dwell_by_site_hour": 1, "dwell_by_weekday": 2,
    "occupancy_by_hour": 4, "occupancy_by_weekday": 4, "occupancy_by_site_weekday": 3,
    "occupancy_by_site_hour": 4,  # the calendar for each of the two means
}


@pytest.mark.parametrize("name", WITH_REFERENCE)
def test_a_report_and_its_reference_run_the_pipeline_once(spark, name):
    """One window finds neighbours; occupancy has one that sweeps a sensor and one that sweeps the
    calendar; a mean over the few rows of a report has its own."""
    df = catalog()[name](spark, SF)
    assert count_of(df, "Window") == WITH_REFERENCE[name]
    assert "reference" in df.columns


@pytest.mark.parametrize("name", ["status_v1", "status_v2", "stays_v1", "occupancy_hourly",
                                  "error_summary_sensor", "stay_summary"])
def test_no_single_partition(spark, name):
    assert "SinglePartition" not in plan_of(catalog()[name](spark, SF))


def test_heatmap_moves_no_sensors_to_one_task(raw):
    plan = plan_of(O.observed_mean(P.guarded_runs(raw), "hour", "sensor"))
    assert "SinglePartition" not in plan and "bucket" in plan


@pytest.mark.parametrize("name", ["usage_by_site_weekday", "usage_by_site_hour", "dwell_by_site_hour"])
def test_site_references_move_no_rows_to_one_task(spark, name):
    plan = plan_of(catalog()[name](spark, SF))
    assert not any("Window" in line and "site" in line for line in plan.splitlines())


def test_no_cartesian_products(spark):
    for name, query in catalog().items():
        plan = plan_of(query(spark, SF))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_the_sample_reads_few_columns(raw):
    """Without copies to drop, places to cut are found without reading payloads."""
    cut = N.cutting(raw.select("sensor", F.col("send_ts").cast("timestamp_ntz").alias("ts"), "row_id"))
    df = raw.sparkSession.range(1).select(cut.alias("cut"))
    scans = [d for name, d in plan_nodes(df, subqueries=True) if "parquet" in name]
    assert len(scans) == 1 and "props" not in scans[0] and "event_id" in scans[0]


@pytest.mark.parametrize("plan", [P.guarded_stays, P.precedence_stays])
def test_windows_over_slices_stay_partitioned(raw, plan):
    """Rows are windowed by sensor and slice; by sensor alone only the ends of slices."""
    df = plan(raw, slice_rows=40)
    assert "SinglePartition" not in plan_of(df)
    windows = [d for name, d in plan_nodes(df) if name == "Window"]
    assert windows and all("slice" in d for d in windows)
