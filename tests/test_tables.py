"""Written tables: reruns, changed days, pruned reads."""

import os

import pytest
from helpers import TESTDATA, plan_nodes, rows
from pyspark.sql import functions as F

from parkpulse.functions.timeparts import in_days
from parkpulse.operators import reports as R
from parkpulse.plans import batch
from parkpulse.sources import tables as T
from parkpulse.plans import catalog as catalog_module
from parkpulse.sources.events import messages_from_events

CHOSEN = ("대신졸음쉼터_#00003",)


def files(folder):
    return {
        os.path.relpath(os.path.join(where, name), folder): os.stat(os.path.join(where, name)).st_mtime_ns
        for where, _, names in os.walk(folder) for name in names if name.startswith("part-")
    }


def same(a, b):
    assert a.keys() == b.keys()
    for name in a:
        assert a[name].dtypes == b[name].dtypes and rows(a[name]) == rows(b[name]), name


@pytest.fixture(scope="module")
def raw(spark):
    return messages_from_events(spark, f"{TESTDATA}/sf0.001")


@pytest.fixture(scope="module")
def fresh(spark, raw, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("fresh"))
    return out, batch.run_batch(raw, out, CHOSEN, ("대신",))


def test_an_equal_run_writes_nothing(raw, fresh):
    out, found = fresh
    before = files(out)
    same(batch.run_batch(raw, out, CHOSEN, ("대신",), mode="update"), found)
    assert files(out) == before


@pytest.mark.parametrize("stop_at", ["stays", "anova"])
def test_a_stopped_run_is_finished(raw, fresh, tmp_path, monkeypatch, stop_at):
    write, out = T.write_table, str(tmp_path)

    def stop(df, path, *rest, **options):
        if path.endswith(f"/{stop_at}"):
            # Some rows are out, the commit never comes.
            write(df.limit(3), path, *rest, **options)
            raise RuntimeError("stopped")
        write(df, path, *rest, **options)

    monkeypatch.setattr(T, "write_table", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        batch.run_batch(raw, out, CHOSEN, ("대신",), mode="update")
    done = files(f"{out}/messages")
    monkeypatch.setattr(T, "write_table", write)
    same(batch.run_batch(raw, out, CHOSEN, ("대신",), mode="update"), fresh[1])
    assert files(f"{out}/messages") == done


def test_other_parameters_replace_what_depends_on_them(raw, fresh, tmp_path):
    out = str(tmp_path)
    batch.run_batch(raw, out, CHOSEN, ("대신",))
    before = files(out)
    batch.run_batch(raw, out, CHOSEN, ("옥천",), mode="update")
    changed = {name.split("/")[0] for name in before.items() ^ files(out).items() for name in name[:1]}
    assert changed == {"error_rates_wide", "manifests"}


# ---- days


def days(spark, *data):
    return spark.createDataFrame(data, "v int, day string").withColumn("day", F.to_date("day"))


FIRST = ((1, "2022-03-01"), (2, "2022-03-02"), (3, "2022-03-03"), (4, None))


def keep(spark, out, data, mode="update"):
    tables = T.Tables(spark, out, mode)
    back = tables.keep(days(spark, *data), "t", T.digest(*map(str, data)), by="day")
    return rows(back), tables


def test_only_changed_days_are_replaced(spark, tmp_path):
    out = str(tmp_path)
    keep(spark, out, FIRST, "error")
    before = files(f"{out}/t")
    second = ((1, "2022-03-01"), (2, "2022-03-02"), (2, "2022-03-02"), (3, "2022-03-03"), (4, None), (5, "2022-03-04"))
    assert keep(spark, out, second)[0] == rows(days(spark, *second))
    after = files(f"{out}/t")
    kept = {name.split("/")[0] for name in before.items() & after.items() for name in name[:1]}
    assert kept == {"day=2022-03-01", "day=2022-03-03", "day=__HIVE_DEFAULT_PARTITION__"}


def test_a_day_that_vanished_is_gone(spark, tmp_path):
    keep(spark, str(tmp_path), FIRST)
    assert keep(spark, str(tmp_path), FIRST[1:])[0] == rows(days(spark, *FIRST[1:]))
    assert keep(spark, str(tmp_path), ())[0] == []
    assert keep(spark, str(tmp_path), FIRST)[0] == rows(days(spark, *FIRST))


@pytest.mark.parametrize("third", [FIRST, FIRST[:1], ((9, "2022-03-02"), *FIRST)])
def test_days_of_a_stopped_run_are_not_trusted(spark, tmp_path, monkeypatch, third):
    """A run replaces days and stops before its commit; the next run has yet another state."""
    out = str(tmp_path)
    keep(spark, out, FIRST)
    commit, calls = T.Tables._commit, []

    def stop(self, name, state):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return commit(self, name, state)

    monkeypatch.setattr(T.Tables, "_commit", stop)
    with pytest.raises(RuntimeError):
        keep(spark, out, (*FIRST[:1], (7, "2022-03-02"), *FIRST[2:], (8, "2022-03-09")))
    monkeypatch.setattr(T.Tables, "_commit", commit)
    assert keep(spark, out, third)[0] == rows(days(spark, *third))


def test_contents_see_repeats_nulls_and_places_but_no_order(spark):
    schema = "a string, b string"
    of = lambda *data: T.contents(spark.createDataFrame(data, schema))
    assert of(("x", None), ("y", "z")) == of(("y", "z"), ("x", None))
    different = [of(("x", None)), of((None, "x")), of(("x", None), ("x", None)), of(("x", "")), of(*[])]
    assert len({str(d) for d in different}) == len(different)


def test_refuses_unknown_modes_and_tables_that_are_there(spark, tmp_path):
    with pytest.raises(ValueError, match="mode"):
        T.Tables(spark, str(tmp_path), "append")
    keep(spark, str(tmp_path), FIRST)
    with pytest.raises(Exception, match="already exists"):
        keep(spark, str(tmp_path), FIRST, "error")
    # The refused run has not touched the commit.
    assert keep(spark, str(tmp_path), FIRST)[1].written == []


# ---- pruned reads


def partition_filters(df):
    scans = [text for name, text in plan_nodes(df, subqueries=True) if name.startswith("Scan parquet")]
    return [text.split("PartitionFilters: [")[1].split("]")[0] for text in scans]


def test_reports_over_days_read_these_days_only(fresh):
    found = fresh[1]
    period = found["stays"].agg(F.min("in_date").alias("a"), F.max("in_date").alias("b")).first()
    first, last = str(period.a), str(period.a.replace(day=28))
    for table, ts, by in (("stays", "in_ts", "in_date"), ("occupancy", "hour", "date")):
        pruned = T.on_days(found[table], ts, by, first, last)
        assert rows(pruned) == rows(found[table].where(in_days(F.col(ts), first, last)))
        assert 0 < pruned.count() < found[table].count()
        assert all(by in text for text in partition_filters(pruned)) and partition_filters(pruned)
    usage = R.usage_by_grain(T.on_days(found["stays"], "in_ts", "in_date", first, last), "hour")
    assert rows(usage) == rows(R.usage_by_grain(found["stays"].where(in_days(F.col("in_ts"), first, last)), "hour"))
    assert partition_filters(usage)


def test_stays_under_way_are_found_from_earlier_folders(fresh):
    stays = fresh[1]["stays"]
    longest = T.longest_stay(stays)
    assert longest >= 1
    one = stays.where(F.date_diff("out_ts", "in_ts") == longest).first()
    day = str(one.out_ts.date())
    got = T.stays_touching(stays, day, day, longest)
    lo = F.lit(day).cast("timestamp_ntz")
    brute = stays.where((F.col("out_ts") >= lo) & (F.col("in_ts") < lo + F.expr("INTERVAL 1 DAY")))
    assert rows(got) == rows(brute)
    assert one.in_ts in [r.in_ts for r in got.collect()]
    assert partition_filters(got)


def test_rows_of_one_row_group_are_dealt_to_all_tasks(spark, monkeypatch):
    """A row group is read by one task, which must not parse it alone as well."""
    seen = {}

    def batch(raw, *_, **__):
        seen["raw"] = raw
        return {"messages": raw}

    monkeypatch.setattr(catalog_module, "run_batch", batch)
    catalog_module.catalog()["table_messages"](spark, f"{TESTDATA}/sf0.001")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        tasks = seen["raw"].select(F.spark_partition_id().alias("task"), "payload").groupBy("task").agg(F.max("payload"), F.count("*"))
        rows = [r[2] for r in tasks.collect()]
    finally:
        spark.conf.set(name, before)
    assert len(rows) > 1 and max(rows) < 0.6 * sum(rows)
    same = messages_from_events(spark, f"{TESTDATA}/sf0.001")
    assert sorted(map(tuple, seen["raw"].collect())) == sorted(map(tuple, same.collect()))
