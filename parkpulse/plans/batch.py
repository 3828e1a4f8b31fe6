"""The whole batch run: every table written once, each later table derived from a written one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkpulse.functions import vocabulary as V
from parkpulse.operators import errors as E
from parkpulse.operators import groupstats as G
from parkpulse.operators import occupancy as O
from parkpulse.operators import reports as R
from parkpulse.operators.classify import classify_guarded
from parkpulse.operators.neighbours import SLICE, SLICE_ROWS, sliced
from parkpulse.operators.stays import enrich_stays, pair_stays
from parkpulse.plans.pipeline import guarded_messages
from parkpulse.sources.tables import Tables, contents, digest

#: Raise whenever the rules of a table change, so that tables written before are not taken for current.
RULES = 1


def run_batch(
    raw: DataFrame,
    out: str,
    selected: Sequence[str] = (),
    sites: Sequence[str] = (),
    mode: str = "error",
    holidays: Sequence[str] = V.HOLIDAYS,
    slice_rows: int = SLICE_ROWS,
    source: str | None = None,
) -> dict[str, DataFrame]:
    """Write messages, codes, stays, occupancy and all reports below `out`.

    Large tables are Parquet, reports CSV. Reading a written table back cuts the lineage, so a
    lost executor never reaches back to the raw files. Error rates and occupancy are complete in
    long form; wide tables are added for the sensors in `selected` and the sites in `sites`.

    Mode "error" refuses tables that are there, "overwrite" replaces them, "update" finishes or brings
    up to date what an earlier run left (see `sources/tables.py`). `source` names the state of the
    messages where the caller knows it, such as the id of a load; otherwise they are read once for it.
    Returns every table as written.
    """
    tables = Tables(raw.sparkSession, out, mode)
    source = source or digest(sorted(contents(raw).items()))
    found: dict[str, DataFrame] = {}

    def keep(df: DataFrame, name: str, made_from: str, by: str | None = None) -> DataFrame:
        found[name] = tables.keep(df.drop(SLICE), name, digest(RULES, made_from), by=by)
        return found[name]

    def report(df: DataFrame, name: str, made_from: str, *options: object) -> None:
        state = digest(RULES, tables.identity(made_from), *options)
        found[name] = tables.keep(df, name, state, "csv")

    messages = keep(guarded_messages(raw, "full", slice_rows), "messages", source)
    coded = keep(
        classify_guarded(sliced(messages, slice_rows), post_report=True).select(
            "row_id", "sensor", "detector", "action", "ts", "status_code"
        ),
        "coded_messages",
        tables.identity("messages"),
    )
    report(E.error_summary(coded, post_report=True), "error_summary", "coded_messages")
    report(E.sequence_errors_daily(coded), "sequence_errors_daily", "coded_messages")
    report(E.sequence_error_rate(coded), "error_rates_monthly", "coded_messages")
    if selected:
        report(E.selected_error_rate(coded, selected), "error_rates_selected", "coded_messages", *selected)
    if sites or selected:
        report(E.error_rate_wide(coded, sites, selected), "error_rates_wide", "coded_messages")

    normal = coded.where(F.col("status_code") == V.OK)
    stays = enrich_stays(pair_stays(sliced(normal, slice_rows)), holidays)
    made_from = digest(tables.identity("coded_messages"), list(holidays))
    stays = keep(stays.withColumn("in_date", F.to_date("in_ts")), "stays", made_from, by="in_date")
    report(R.stay_summary(stays), "stay_summary", "stays")

    sensors = R.sensor_list(messages)
    cells = O.hourly_occupancy(stays).withColumn("date", F.to_date("hour"))
    cells = keep(cells, "occupancy", tables.identity("stays"), by="date")
    if selected:
        report(O.to_wide(cells, selected), "occupancy_wide", "occupancy")
    known = tables.identity("messages")
    report(O.transposed_profile(O.hour_profile(sensors, stays)), "occupancy_profile", "stays", known)
    report(O.column_summary(sensors, stays), "occupancy_summary", "stays", known)

    sample = stays.select(
        "site", "dwell_sec", F.hour("in_ts").cast("bigint").alias("arrival_hour")
    )
    responses = ("dwell_sec", "arrival_hour")
    report(G.manova(sample, "site", responses), "manova", "stays")
    report(G.anova(sample, "site", responses), "anova", "stays")
    for response in responses:
        report(G.tukey(sample, "site", response), f"tukey_{response}", "stays")
    return found
