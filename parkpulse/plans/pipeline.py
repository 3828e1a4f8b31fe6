"""Raw messages to coded messages, stays and cells.

Two rule sets give different codes and both are kept. `guarded` drops incomplete messages and
copies first and checks the sequence only around normal messages; `precedence` keeps every
message and lets the sequence checks win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from parkpulse.operators.classify import classify_guarded, classify_precedence
from parkpulse.operators.neighbours import (
    SLICE,
    SLICE_ROWS,
    cutting,
    placed,
    without_ghosts,
    without_later_copies,
)
from parkpulse.operators.occupancy import hour_runs, hourly_occupancy
from parkpulse.operators.parse import (
    drop_duplicates,
    parse_guarded,
    parse_precedence,
    with_names,
)
from parkpulse.operators.stays import adjacent_stays, pair_stays


def guarded_messages(raw: DataFrame, style: str = "short", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Parsed, complete, distinct messages."""
    return without_ghosts(_placed_messages(raw, style, slice_rows)).drop(SLICE)


def _placed_messages(raw: DataFrame, style: str, slice_rows: int) -> DataFrame:
    """Parsed, complete, distinct messages, placed by sensor and slice for the windows that follow.

    The messages are shuffled once, and copies are dropped in place.
    """
    named = with_names(raw, style)
    cut = cutting(named, slice_rows, copies=True)
    parsed = parse_guarded(without_later_copies(named, cut))
    return drop_duplicates(placed(parsed, cut, copies=True))


def guarded(
    raw: DataFrame,
    style: str = "short",
    post_report: bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    return _guarded(raw, style, post_report, slice_rows).drop(SLICE)


def _guarded(
    raw: DataFrame,
    style: str = "short",
    post_report: bool = False,
    slice_rows: int = SLICE_ROWS,
    keep_next: bool = False,
) -> DataFrame:
    return classify_guarded(_placed_messages(raw, style, slice_rows), post_report, keep_next)


def precedence(raw: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    return _precedence(raw, slice_rows).drop(SLICE)


def _precedence(raw: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    named = with_names(raw, "charclass")
    cut = cutting(named.select("sensor", "ts", "row_id"), slice_rows)
    return classify_precedence(placed(parse_precedence(named), cut))


def guarded_stays(raw: DataFrame, **options) -> DataFrame:
    return adjacent_stays(_guarded(raw, keep_next=True, **options))


def precedence_stays(raw: DataFrame, require_departure: bool = False, **options) -> DataFrame:
    return pair_stays(_precedence(raw, **options), require_departure)


def guarded_cells(raw: DataFrame, **options) -> DataFrame:
    return hourly_occupancy(guarded_stays(raw, **options))


def precedence_cells(raw: DataFrame, **options) -> DataFrame:
    return hourly_occupancy(precedence_stays(raw, **options))


def guarded_runs(raw: DataFrame, **options) -> DataFrame:
    return hour_runs(guarded_stays(raw, **options))
