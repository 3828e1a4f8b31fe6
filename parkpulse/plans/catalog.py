"""Every named query: (spark, directory of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parkpulse.functions.timeparts import calendar_bucket, in_days, weekday_name
from parkpulse.operators import errors as E
from parkpulse.operators import groupstats as G
from parkpulse.operators import occupancy as O
from parkpulse.operators import reports as R
from parkpulse.operators.classify import status_label
from parkpulse.operators.parse import parse_precedence, site_of, with_names
from parkpulse.operators.stays import enrich_stays
from parkpulse.plans import pipeline as P
from parkpulse.plans.batch import run_batch
from parkpulse.sources.events import messages_from_events
from parkpulse.sources.sinks import work_folder
from parkpulse.sources.tables import digest

Query = Callable[[SparkSession, str], DataFrame]

DAYS = ("2022-01-24", "2022-02-06")
SITES = ("대신", "옥천", "영천")
SELECTED = ("대신졸음쉼터_#00003", "옥천졸음쉼터_#00013", "영천졸음쉼터_#00011")
SELECTED_SHORT = tuple(s.replace("졸음쉼터_", "") for s in SELECTED)
HOT_SENSOR, HOT_ROWS = "주차센서_옥천졸음쉼터_#00001", 100
MESSAGE = ("sensor", "detector", "action", "ts", "status_code")


def _raw(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(messages_from_events(spark, sf_dir))


def _dominated(raw: DataFrame) -> DataFrame:
    """Every second message comes from one sensor."""
    hot = F.when(F.col("row_id") % 2 == 0, F.lit(HOT_SENSOR))
    return raw.withColumn("sensor", F.coalesce(hot, "sensor"))


def _batch(raw: DataFrame) -> DataFrame:
    return P.guarded(raw, style="full", post_report=True)


def _batch_stays(raw: DataFrame) -> DataFrame:
    return P.guarded_stays(raw, style="full", post_report=True)


def _sensors(raw: DataFrame) -> DataFrame:
    return R.sensor_list(P.guarded_messages(raw, "full"))


def _profile(raw: DataFrame) -> DataFrame:
    return O.transposed_profile(O.hour_profile(_sensors(raw), _batch_stays(raw)))


def _percent(cells: DataFrame) -> DataFrame:
    return cells.select(
        "sensor", "hour", "occupied_sec",
        (F.col("pct100") / F.lit(100.0)).alias("occupancy_pct"),
    )


def _named(report: DataFrame) -> DataFrame:
    named = report.withColumn("weekday_name", weekday_name(F.col("weekday")))
    return named.orderBy(*[c for c in ("site", "weekday") if c in report.columns])


def _in(part: str) -> Column:
    return {"hour": F.hour, "weekday": F.weekday}[part](F.col("in_ts"))


def _observed(raw: DataFrame, part: str, group: str | None = None, days=None) -> DataFrame:
    return O.observed_mean(P.guarded_runs(raw), part, group, days)


def _observed_beside_all(raw: DataFrame, part: str, group: str) -> DataFrame:
    """Means per group, and the mean of the means over all sensors, from the same sums."""
    sums = O.observed_sums(P.guarded_runs(raw), part, group)
    overall = O.mean_of_sums(O.together(sums), part)
    return O.mean_of_sums(sums, part, group).withColumn("reference", R.mean_value(overall, "occupancy_pct"))


def _sparse(raw: DataFrame, period: str) -> DataFrame:
    hour = F.col("hour")
    key = {"date": F.to_date, "weekday": F.weekday, "month": F.month}[period](hour)
    return O.sparse_mean(P.precedence_cells(raw), {"site": F.col("site"), period: key})


def _with_mean(report: DataFrame) -> DataFrame:
    return report.withColumn("reference", R.mean_value(report, "occupancy_pct"))


def _over_sites(by_site: DataFrame, period: str) -> DataFrame:
    """Means over the sites per period, beside the mean of all site means."""
    mean = by_site.agg(F.round(F.avg("occupancy_pct"), 1).alias("mean")).scalar()
    return O.mean_over_sites(by_site, [period]).withColumn("reference", mean)


def _rebinned(raw: DataFrame, width: str) -> DataFrame:
    period = calendar_bucket(F.col("hour"), width)
    return O.sparse_mean(P.precedence_cells(raw), {"site": F.col("site"), "period": period})


def _stay_table(stays: DataFrame) -> DataFrame:
    return stays.select("sensor", "in_ts", "out_ts", "dwell_sec")


def _responses(raw: DataFrame) -> DataFrame:
    return P.guarded_stays(raw).select(
        "site", "dwell_sec", F.hour("in_ts").cast("bigint").alias("arrival_hour")
    )


def _fractional_responses(raw: DataFrame) -> DataFrame:
    """Dwell and time of arrival in hours, with fractions."""
    arrival = F.hour("in_ts") + F.minute("in_ts") / F.lit(60.0)
    return P.guarded_stays(raw).select(
        "site", (F.col("dwell_sec") / F.lit(3600.0)).alias("dwell_hours"), arrival.alias("arrival_hours")
    )


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _nine_digits(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.format_string("%.8e", c).cast("double") for c in columns})


def _action_recode(raw: DataFrame) -> DataFrame:
    messages = P.guarded_messages(raw)
    return messages.groupBy("fault", "action").agg(F.count(F.lit(1)).alias("n"))


def _action_category(raw: DataFrame) -> DataFrame:
    messages = parse_precedence(with_names(raw, "charclass"))
    return messages.groupBy("detector", "action").agg(F.count(F.lit(1)).alias("n"))


def _labels(raw: DataFrame) -> DataFrame:
    coded = P.guarded(raw)
    return coded.select(
        site_of(F.col("sensor")).alias("site"), "sensor", "detector", "action", "ts",
        status_label(F.col("status_code")).alias("status"),
    )


def _code_counts_by(raw: DataFrame, by: str, distinct: bool = False) -> DataFrame:
    coded = P.precedence(raw)
    coded = E.distinct_coded(coded) if distinct else coded
    return E.code_counts(coded, E.report_key(by).alias(by)).orderBy(by)


def _messages(raw: DataFrame) -> DataFrame:
    return P.guarded_messages(raw, "full").select(
        "row_id", "sensor", "ts", "device_type", "detector", "battery", "fault", "rssi", "snr",
        "action",
    )


def _table(name: str, *columns: str) -> Query:
    """A table of the batch run as written and read back. Within an application the run is brought
    up to date, so the tables are written once however many of them are asked for."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = work_folder(spark, f"batch-{digest(sf_dir)[:16]}")
        raw = messages_from_events(spark, sf_dir, spread=True)
        table = run_batch(raw, out, SELECTED, SITES, mode="update")[name]
        return table.select(*columns) if columns else table

    return query


def catalog() -> dict[str, Query]:
    q: dict[str, Query] = {
        # messages
        "parsed_messages": _raw(_messages),
        "action_recode_v1": _raw(_action_recode),
        "action_category_v2": _raw(_action_category),
        "status_v1": _raw(lambda raw: P.guarded(raw).select(*MESSAGE)),
        "status_v1_post_report": _raw(lambda raw: _batch(raw).select(*MESSAGE)),
        "status_v2": _raw(lambda raw: P.precedence(raw).select(*MESSAGE)),
        "status_labels": _raw(_labels),
        "action_counts": _raw(lambda raw: R.value_counts(_batch(raw), "action")),
        "status_counts": _raw(lambda raw: R.value_counts(_batch(raw), "status_code")),
        "sensor_list": _raw(lambda raw: _sensors(raw).orderBy("sensor")),
        "data_period": _raw(lambda raw: R.data_period(P.guarded_messages(raw))),
        # errors
        "error_summary_batch": _raw(lambda raw: E.error_summary(_batch(raw), post_report=True)),
        "error_summary_sensor": _raw(lambda raw: E.error_summary(P.guarded(raw), "sensor")),
        "error_summary_site": _raw(lambda raw: E.error_summary(P.guarded(raw), "site")),
        "error_summary_v2_site": _raw(lambda raw: _code_counts_by(raw, "site")),
        "error_summary_v2_sensor": _raw(lambda raw: _code_counts_by(raw, "sensor")),
        "error_summary_v2_distinct": _raw(lambda raw: _code_counts_by(raw, "site", distinct=True)),
        "error_by_sensor_ts": _raw(lambda raw: E.code_counts(P.precedence(raw), "sensor", "ts")),
        "error_by_sensor_ts_in_range": _raw(
            lambda raw: E.code_counts(P.precedence(raw), "sensor", "ts").where(
                in_days(F.col("ts"), *DAYS)
            )
        ),
        "sequence_errors_daily": _raw(lambda raw: E.sequence_errors_daily(_batch(raw))),
        "error_rate_site_month": _raw(lambda raw: E.sequence_error_rate(_batch(raw))),
        "error_rate_selected_month": _raw(
            lambda raw: E.selected_error_rate(_batch(raw), SELECTED)
        ),
        "error_rate_site_month_wide": _raw(
            lambda raw: E.error_rate_wide(_batch(raw), SITES, SELECTED)
        ),
        # stays
        "stays_v1": _raw(lambda raw: _stay_table(P.guarded_stays(raw))),
        "stays_v2": _raw(lambda raw: _stay_table(P.precedence_stays(raw))),
        "stays_v1_cut": _raw(
            lambda raw: _stay_table(P.guarded_stays(_dominated(raw), slice_rows=HOT_ROWS))
        ),
        "stays_v2_cut": _raw(
            lambda raw: _stay_table(P.precedence_stays(_dominated(raw), slice_rows=HOT_ROWS))
        ),
        "stays_v2_departures": _raw(
            lambda raw: _stay_table(P.precedence_stays(raw, require_departure=True))
        ),
        "stays_enriched": _raw(lambda raw: enrich_stays(_batch_stays(raw))),
        "stays_two_day_types": _raw(
            lambda raw: enrich_stays(P.guarded_stays(raw, style="full"), new_year=None)
        ),
        "stays_in_range": _raw(
            lambda raw: _stay_table(P.guarded_stays(raw)).where(in_days(F.col("in_ts"), *DAYS))
        ),
        "stay_summary": _raw(lambda raw: R.stay_summary(_batch_stays(raw))),
        # usage
        "usage_by_hour": _raw(
            lambda raw: R.with_reference_count(R.usage_by_grain(P.guarded_stays(raw), "hour"))
        ),
        "usage_by_site_hour": _raw(
            lambda raw: R.with_all_sites_count(
                R.usage_by(P.guarded_stays(raw), site=F.col("site"), hour=_in("hour")), "hour"
            )
        ),
        "usage_by_weekday": _raw(
            lambda raw: _named(
                R.with_reference_count(R.usage_by_grain(P.guarded_stays(raw), "weekday"))
            )
        ),
        "usage_by_site_weekday": _raw(
            lambda raw: _named(
                R.with_site_reference(
                    R.usage_by(
                        P.guarded_stays(raw), site=F.col("site"), weekday=_in("weekday")
                    ),
                    "weekday",
                )
            )
        ),
        "top_sensors_count": _raw(
            lambda raw: R.top(
                R.usage_by(P.guarded_stays(raw), sensor=F.col("sensor")), "usage_count"
            )
        ),
        "peak_usage": _raw(lambda raw: R.peak_usage(P.guarded_stays(raw))),
        # dwell
        "dwell_by_hour": _raw(
            lambda raw: R.with_reference_value(
                R.dwell_by(P.guarded_stays(raw), 1, hour=_in("hour")), "dwell_min"
            )
        ),
        "dwell_by_site_hour": _raw(
            lambda raw: R.dwell_by_site_hour(P.guarded_stays(raw))
        ),
        "dwell_by_weekday": _raw(
            lambda raw: _named(
                R.with_reference_value(
                    R.dwell_by(P.guarded_stays(raw), 2, weekday=_in("weekday")), "dwell_min", 2, to=1
                )
            )
        ),
        "dwell_by_site_weekday": _raw(
            lambda raw: _named(
                R.dwell_by(P.guarded_stays(raw), 2, site=F.col("site"), weekday=_in("weekday"))
            )
        ),
        "top_sensors_dwell": _raw(
            lambda raw: R.top(
                R.dwell_by(P.guarded_stays(raw), 1, sensor=F.col("sensor")), "dwell_min"
            )
        ),
        "peak_dwell": _raw(lambda raw: R.peak_dwell(P.guarded_stays(raw))),
        # occupancy
        "occupancy_hourly": _raw(lambda raw: _percent(P.guarded_cells(raw))),
        "occupancy_hourly_v2": _raw(lambda raw: _percent(P.precedence_cells(raw))),
        "occupancy_in_range": _raw(
            lambda raw: _percent(O.cells_in_days(P.precedence_stays(raw), *DAYS))
        ),
        "occupancy_grid_dense": _raw(
            lambda raw: O.dense_grid(_sensors(raw), _batch_stays(raw))
        ),
        "occupancy_wide": _raw(lambda raw: O.to_wide(P.guarded_cells(raw), SELECTED_SHORT)),
        "occupancy_unpivot": _raw(
            lambda raw: O.from_wide(_profile(raw), "sensor", "hour_column", "fraction")
        ),
        "occupancy_by_hour": _raw(
            lambda raw: R.with_reference_value(_observed(raw, "hour"), "occupancy_pct")
        ),
        "occupancy_by_hour_in_range": _raw(lambda raw: _observed(raw, "hour", days=DAYS)),
        "occupancy_by_site_hour": _raw(
            lambda raw: _observed_beside_all(raw, "hour", "site")
        ),
        "occupancy_heatmap": _raw(
            lambda raw: _observed(raw, "hour", "sensor").select(
                site_of(F.col("sensor")).alias("site"), "sensor", "hour", "occupancy_pct"
            )
        ),
        "occupancy_profile_transposed": _raw(_profile),
        "occupancy_summary_stats": _raw(
            lambda raw: O.column_summary(_sensors(raw), _batch_stays(raw))
        ),
        "occupancy_by_weekday": _raw(
            lambda raw: _named(
                R.with_reference_value(_observed(raw, "weekday"), "occupancy_pct")
            )
        ),
        "occupancy_by_site_weekday": _raw(
            lambda raw: _named(_with_mean(_observed(raw, "weekday", "site")))
        ),
        "top_sensors_occupancy": _raw(
            lambda raw: R.top_sensors_by_occupancy(P.guarded_cells(raw))
        ),
        # group comparison
        "anova_dwell_by_site": _raw(
            lambda raw: _rounded(
                _nine_digits(
                    G.anova(_responses(raw), "site", ("dwell_sec", "arrival_hour")),
                    "ss_between", "ss_within",
                ),
                f_value=6, p_value=6,
            )
        ),
        "anova_dwell_hours_by_site": _raw(
            lambda raw: _rounded(
                _nine_digits(
                    G.anova(_fractional_responses(raw), "site", ("dwell_hours", "arrival_hours")),
                    "ss_between", "ss_within",
                ),
                f_value=6, p_value=6,
            )
        ),
        "manova_dwell": _raw(
            lambda raw: _rounded(
                G.manova(_responses(raw), "site", ("dwell_sec", "arrival_hour")),
                pillai=9, approx_f=6, p_value=6,
            )
        ),
        "manova_tests_dwell": _raw(
            lambda raw: _rounded(
                G.manova_tests(_responses(raw), "site", ("dwell_sec", "arrival_hour")),
                statistic=9, approx_f=6, p_value=6,
            )
        ),
        "tukey_dwell": _raw(
            lambda raw: _rounded(
                G.tukey(_responses(raw), "site", "dwell_sec"),
                diff=3, lower=1, upper=1, std_error=3, q_value=6, p_adjusted=4,
            )
        ),
    }
    # tables of the batch run
    q["table_messages"] = _table("messages")
    q["table_coded_messages"] = _table("coded_messages", *MESSAGE)
    q["table_error_summary"] = _table("error_summary")
    q["table_sequence_errors_daily"] = _table("sequence_errors_daily")
    q["table_error_rates_monthly"] = _table("error_rates_monthly")
    q["table_error_rates_selected"] = _table("error_rates_selected")
    q["table_error_rates_wide"] = _table("error_rates_wide")
    q["table_stays"] = _table("stays")
    q["table_stay_summary"] = _table("stay_summary")
    q["table_occupancy"] = _table("occupancy", "sensor", "hour", "occupied_sec", "date")
    q["table_occupancy_profile"] = _table("occupancy_profile")
    q["table_occupancy_summary"] = _table("occupancy_summary")
    for period in ("date", "weekday", "month"):
        q[f"occupancy_site_{period}"] = _raw(lambda raw, p=period: R.with_mean_share(_sparse(raw, p)))
        q[f"occupancy_{period}_all"] = _raw(lambda raw, p=period: _over_sites(_sparse(raw, p), p))
    for name in ("date", "hour", "weekday", "month"):
        q[f"usage_by_grain_{name}"] = _raw(
            lambda raw, g=name: R.usage_by_grain(P.precedence_stays(raw), g)
        )
    for width in ("day", "month", "half", "year"):
        q[f"occupancy_rebinned_{width}"] = _raw(lambda raw, w=width: _rebinned(raw, w))
        q[f"occupancy_rebinned_{width}_all"] = _raw(
            lambda raw, w=width: O.mean_over_sites(_rebinned(raw, w), ["period"])
        )
        q[f"usage_rebinned_{width}"] = _raw(
            lambda raw, w=width: R.usage_rebinned(P.precedence_stays(raw), w)
        )
    return q
