"""Calendars, rounding, top lists, peaks, summaries and group statistics."""

import numpy as np
import pytest
from helpers import TESTDATA
from pyspark.sql import functions as F
from test_occupancy import stays_of

from parkpulse.functions import timeparts as T
from parkpulse.functions.distributions import f_upper_tail, range_quantile, range_upper_tail
from parkpulse.functions.numbers import rounded_ratio
from parkpulse.operators import errors as E
from parkpulse.operators import groupstats as G
from parkpulse.operators import reports as R
from parkpulse.operators.stays import enrich_stays
from parkpulse.plans import pipeline as P
from parkpulse.sources.events import messages_from_events


def at_hours(spark, counts, minutes=10):
    """counts: {hour: stays}; minutes: dwell, or {hour: dwell}."""
    spans = []
    for hour, n in counts.items():
        dwell = minutes if isinstance(minutes, int) else minutes[hour]
        end = f"2022-03-01 {hour + dwell // 60:02d}:{dwell % 60:02d}:00"
        spans += [(f"2022-03-01 {hour:02d}:00:00", end)] * n
    return stays_of(spark, *spans)


def test_rounding_is_half_up_and_exact(spark):
    df = spark.createDataFrame([(5, 2), (7, 20), (1005, 1000), (0, 3)], "a bigint, b bigint")
    got = df.select(
        rounded_ratio(F.col("a"), F.col("b")).alias("r0"),
        rounded_ratio(F.col("a"), F.col("b"), 2).alias("r2"),
    ).collect()
    assert [r.r0 for r in got] == [3.0, 0.0, 1.0, 0.0]
    assert [r.r2 for r in got] == [2.5, 0.35, 1.01, 0.0]


@pytest.mark.parametrize("ts,expected", [
    ("2022-01-27 23:59:59", "평일"), ("2022-01-28 00:00:00", "설연휴"),
    ("2022-02-02 00:00:00", "설연휴"), ("2022-02-02 00:00:01", "휴일"),
    ("2022-03-01 12:00:00", "휴일"), ("2022-03-05 12:00:00", "휴일"),
    ("2022-03-07 12:00:00", "평일"),
])
def test_day_types(spark, ts, expected):
    df = spark.createDataFrame([(ts,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert df.select(T.day_type(F.col("t"))).first()[0] == expected
    two_way = df.select(T.day_type(F.col("t"), new_year=None)).first()[0]
    assert two_way == ("휴일" if ts.startswith("2022-02-02") else
                       "평일" if expected == "설연휴" else expected)


def test_day_and_night(spark):
    stays = stays_of(spark, *[(f"2022-03-01 {h}", f"2022-03-01 {h}", "대신졸음쉼터_#07") for h in
                              ("06:59:59", "07:00:00", "18:59:59", "19:00:00")])
    rows = enrich_stays(stays).orderBy("in_ts").collect()
    assert [r.day_night for r in rows] == ["밤", "낮", "낮", "밤"]
    assert {(r.site, r.detector_no, r.weekday_name) for r in rows} == {("대신", 7, "Tuesday")}


def test_calendar_buckets(spark):
    df = spark.createDataFrame([("2022-08-17 10:00:00",)], "t string")
    t = F.col("t").cast("timestamp_ntz")
    got = df.select(*[T.calendar_bucket(t, w) for w in ("day", "month", "half", "year")]).first()
    assert [str(d) for d in got] == ["2022-08-17", "2022-08-01", "2022-07-01", "2022-01-01"]
    with pytest.raises(ValueError):
        T.calendar_bucket(t, "decade")
    with pytest.raises(ValueError):
        T.grain(t, "minute")


def test_day_range_includes_both_days(spark):
    stays = stays_of(spark, *[(t, t) for t in (
        "2022-02-28 23:59:59", "2022-03-01 00:00:00", "2022-03-02 23:59:59", "2022-03-03 00:00:00"
    )])
    assert stays.where(T.in_days(F.col("in_ts"), "2022-03-01", "2022-03-02")).count() == 2


def test_top_breaks_ties_by_name(spark):
    stays = stays_of(spark, *[("2022-03-01 10:00:00", "2022-03-01 10:10:00", f"대신#{i}")
                              for i in (3, 1, 2, 5, 4, 7, 6)])
    top = R.top(R.usage_by(stays, sensor=F.col("sensor")), "usage_count").collect()
    assert [r.sensor for r in top] == [f"대신#{i}" for i in (1, 2, 3, 4, 5)]


def test_usage_peak(spark):
    assert tuple(R.peak_usage(at_hours(spark, {0: 1, 5: 1, 9: 1, 12: 1})).first()) == (1.0, 1, None, None)
    assert tuple(R.peak_usage(at_hours(spark, {0: 9, 5: 1, 9: 1, 20: 8})).first()) == (5.0, 9, 0, 20)


def test_dwell_peak(spark):
    one = {1: 1, 3: 1, 10: 1, 14: 1}
    night = R.peak_dwell(at_hours(spark, one, {1: 50, 3: 59, 10: 5, 14: 5})).first()
    assert (night.longest_hour, night.peak_start, night.peak_end) == (3, 0, 3)
    day = R.peak_dwell(at_hours(spark, one, {1: 5, 3: 5, 10: 59, 14: 50})).first()
    assert (day.longest_hour, day.peak_start, day.peak_end) == (10, 10, 14)
    assert (day.max_dwell_min, day.mean_dwell_min) == (59.0, 29.8)


def test_stay_summary_skips_empty_days(spark):
    stays = stays_of(spark, ("2022-03-01 10:00:00", "2022-03-01 10:10:00"),
                     ("2022-03-01 11:00:00", "2022-03-01 11:20:00"),
                     ("2022-03-09 10:00:00", "2022-03-09 10:01:15"))
    assert tuple(R.stay_summary(stays).first()) == ("대신#01", 3, 10.0, 20.0, 1.3, 2.0, 2)


def test_references(spark):
    stays = stays_of(
        spark, ("2022-03-01 10:00:00", "2022-03-01 10:10:00"),
        ("2022-03-01 10:00:00", "2022-03-01 10:10:00", "옥천#02"),
        ("2022-03-02 10:00:00", "2022-03-02 10:10:00", "옥천#02"),
    )
    weekday = F.weekday("in_ts")
    usage = R.usage_by(stays, site=F.col("site"), weekday=weekday)
    assert {r.reference for r in R.with_site_reference(usage, "weekday").collect()} == {1.0}
    total = R.with_reference_count(R.usage_by(stays, weekday=weekday))
    assert {r.reference for r in total.collect()} == {2.0}


def test_reference_of_hundredths_may_have_one_decimal(spark):
    report = spark.createDataFrame([(1, 10.06), (2, 10.08)], "k int, v double")
    assert R.with_reference_value(report, "v", 2).first().reference == 10.07
    assert R.with_reference_value(report, "v", 2, to=1).first().reference == 10.1


def test_error_totals_can_exceed_the_messages(spark):
    raw = messages_from_events(spark, f"{TESTDATA}/sf0.01")
    coded = P.guarded(raw, style="full", post_report=True)
    report = E.error_summary(coded, post_report=True)
    by_code = {r.status_code: r.n for r in R.value_counts(coded, "status_code").collect()}
    assert by_code == {0: 3140, 1: 882, 2: 925, 3: 4088, 4: 965}
    sums = report.agg(F.sum("n_sequence"), F.sum("n_post_report"), F.sum("n_periodic")).first()
    assert tuple(sums) == (4088, 965, 882)
    with pytest.raises(ValueError):
        E.error_summary(coded, "country")


@pytest.mark.parametrize("sf,guarded,precedence", [
    ("0.001", (152, 5_246_759), (191, 11_275_659)),
    ("0.01", (1_533, 55_852_813), (1_920, 121_664_773)),
])
def test_stays_known_totals(spark, sf, guarded, precedence):
    raw = messages_from_events(spark, f"{TESTDATA}/sf{sf}")
    totals = [
        tuple(s.agg(F.count("*"), F.sum("dwell_sec")).first())
        for s in (P.guarded_stays(raw), P.precedence_stays(raw))
    ]
    assert totals == [guarded, precedence]


# ---- group statistics: three groups of three, sums of squares by hand


@pytest.fixture(scope="module")
def groups(spark):
    data = [("a", 1, 2), ("a", 2, 1), ("a", 3, 3), ("b", 4, 2), ("b", 5, 4), ("b", 6, 3),
            ("c", 7, 9), ("c", 8, 7), ("c", 9, 8)]
    return spark.createDataFrame(data, "g string, y bigint, z bigint")


def test_anova(groups):
    rows = {r.response: r for r in G.anova(groups, "g", ("y", "z")).collect()}
    y = rows["y"]
    assert (y.df_between, y.df_within) == (2, 6)
    assert (y.ss_between, y.ss_within, y.f_value) == (54.0, 6.0, 27.0)
    assert y.p_value == pytest.approx((1 + 2 * 27 / 6) ** -3, rel=1e-9)
    assert rows["z"].ss_between == pytest.approx(62.0)


def test_manova(groups):
    r = G.manova(groups, "g", ("y", "z")).first()
    # H = [[54, 54], [54, 62]], E = [[6, 1], [1, 6]] by hand.
    h, e = (54, 54, 62), (6, 1, 6)
    t = [a + b for a, b in zip(h, e)]
    pillai = (h[0] * t[2] - 2 * h[1] * t[1] + h[2] * t[0]) / (t[0] * t[2] - t[1] ** 2)
    assert r.pillai == pytest.approx(pillai)
    assert (r.num_df, r.den_df) == (4.0, 12.0)
    assert r.approx_f == pytest.approx(6 / 2 * pillai / (2 - pillai))
    assert 0 < r.p_value < 0.01


def test_manova_of_three_responses_by_all_tests(spark):
    rnd = np.random.default_rng(5)
    group = np.repeat(np.arange(4), 9)
    y = rnd.normal(size=(36, 3)) @ [[1, 0.5, 0], [0, 2, 0.3], [0, 0, 1]] + group[:, None] * [0.8, -0.5, 0.1]
    frame = spark.createDataFrame(
        [(f"g{g}", *map(float, v)) for g, v in zip(group, y)] + [("g0", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)],
        "g string, a double, b double, c double",
    )
    got = {r.test: r for r in G.manova_tests(frame, "g", ("a", "b", "c")).collect()}
    means = np.array([y[group == g].mean(axis=0) for g in range(4)])[group]
    e, h = (y - means).T @ (y - means), (means - y.mean(axis=0)).T @ (means - y.mean(axis=0))
    roots = np.sort(np.linalg.eigvals(np.linalg.inv(e) @ h).real)[::-1]
    expected = {
        "pillai": np.trace(h @ np.linalg.inv(h + e)),
        "wilks": np.linalg.det(e) / np.linalg.det(h + e),
        "hotelling_lawley": np.trace(h @ np.linalg.inv(e)),
        "roy": roots[0],
    }
    assert {t: r.statistic for t, r in got.items()} == pytest.approx(expected, rel=1e-9)
    # p = 3 responses, q = 3, 32 rows within: s = 3, m = -1/2, n = 14.
    assert {t: (r.num_df, r.den_df) for t, r in got.items()} == {
        "pillai": (9.0, 96.0), "wilks": (9.0, pytest.approx(73.16, abs=0.01)), "hotelling_lawley": (9.0, 86.0), "roy": (3.0, 32.0)
    }
    assert got["pillai"].approx_f == pytest.approx(96 / 9 * expected["pillai"] / (3 - expected["pillai"]))
    assert got["hotelling_lawley"].approx_f == pytest.approx(86 * expected["hotelling_lawley"] / 27)
    assert got["roy"].approx_f == pytest.approx(32 * roots[0] / 3)
    assert all(0 < r.p_value < 1 for r in got.values())
    # One response is the plain analysis of variance, whichever test is asked.
    f = G.anova(frame.na.drop(), "g", ("a",)).first().f_value
    assert [r.approx_f for r in G.manova_tests(frame.na.drop(), "g", ("a",)).collect()] == pytest.approx([f] * 4)


def test_manova_of_redundant_constant_and_missing_data(spark):
    frame = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 4.0, 8.0), ("b", 5.5, 11.0)], "g string, y double, z double")
    assert all(r.statistic is None and r.p_value is None for r in G.manova_tests(frame, "g", ("y", "z")).collect())
    constant = frame.withColumn("z", F.lit(3.0))
    assert all(r.statistic is None for r in G.manova_tests(constant, "g", ("y", "z")).collect())
    assert G.manova_tests(frame.limit(0), "g", ("y",)).count() == 0
    assert G.manova_tests(frame.where("g = 'a'"), "g", ("y",)).count() == 0
    apart = frame.withColumn("y", F.when(F.col("g") == "a", 0.0).otherwise(1.0))
    got = {r.test: r for r in G.manova_tests(apart, "g", ("y",)).collect()}
    assert got["pillai"].statistic == pytest.approx(1.0) and got["wilks"].statistic == pytest.approx(0.0, abs=1e-12)


def test_tukey(groups):
    rows = {r.comparison: r for r in G.tukey(groups, "g", "y").collect()}
    assert set(rows) == {"b-a", "c-a", "c-b"}
    r = rows["b-a"]
    assert (r["diff"], r.std_error) == (3.0, pytest.approx((1 / 3) ** 0.5))
    # Critical value 4.339 for 3 groups and 6 degrees of freedom, from published tables.
    assert r.upper - r["diff"] == pytest.approx(4.339 * r.std_error, abs=2e-3)
    assert rows["c-a"].p_adjusted < r.p_adjusted < 0.05


@pytest.mark.parametrize("factor,shift", [(0.1, 0.0), (1.0, 1e9), (1e-3, 0.25)])
def test_tests_do_not_depend_on_unit_and_origin(groups, factor, shift):
    moved = groups.select("g", (F.col("y") * factor + shift).alias("y"), (F.col("z") * factor + shift).alias("z"))
    f = {r.response: r.f_value for r in G.anova(moved, "g", ("y", "z")).collect()}
    assert f == pytest.approx({"y": 27.0, "z": 31.0}, rel=1e-6)
    assert G.manova(moved, "g", ("y", "z")).first().pillai == pytest.approx(
        G.manova(groups, "g", ("y", "z")).first().pillai, rel=1e-6
    )
    p = {r.comparison: r.p_adjusted for r in G.tukey(moved, "g", "y").collect()}
    assert p == pytest.approx({r.comparison: r.p_adjusted for r in G.tukey(groups, "g", "y").collect()}, rel=1e-5)


def test_fractions_by_hand(spark):
    data = [("a", "0.5"), ("a", "1.5"), ("b", "2.25"), ("b", "2.75"), ("c", "4.0"), ("c", "5.0")]
    text = spark.createDataFrame(data, "g string, y string")
    for kind in ("double", "decimal(6,2)"):
        r = G.anova(text.withColumn("y", F.col("y").cast(kind)), "g", ("y",)).first()
        # Means 1, 2.5, 4.5 around 8/3; squares within 0.5 + 0.125 + 0.5.
        assert r.ss_within == pytest.approx(1.125)
        assert r.ss_between == pytest.approx(2 * (25 + 0.25 + 30.25) / 9)
        assert r.f_value == pytest.approx((r.ss_between / 2) / (1.125 / 3))


def test_tukey_has_no_limit_on_groups(spark):
    many = spark.range(3000).select((F.col("id") % 600).cast("string").alias("g"), (F.col("id") % 7).alias("y"))
    pairs = G.tukey(many, "g", "y").select("comparison")
    assert pairs.count() == pairs.distinct().count() == 600 * 599 // 2


def test_tail_probabilities():
    assert f_upper_tail(1180.161, 2, 147) == pytest.approx(2.8568e-91, rel=1e-3)
    assert f_upper_tail(4.0, 1, 1e9) == pytest.approx(0.0455003, abs=1e-6)
    assert f_upper_tail(0.0, 2, 5) == 1.0
    assert range_quantile(0.95, 3, 10) == pytest.approx(3.877, abs=1e-3)
    assert range_quantile(0.95, 5, 20) == pytest.approx(4.232, abs=1e-3)
    assert range_upper_tail(3.314, 3, 1e6) == pytest.approx(0.05, abs=1e-4)
