"""Written tables that a later run replaces only where they changed, and reading some days of them.

A table is committed by its manifest, written last: what the table was made from and, per folder of a
day, a row count and two sums of row hashes. With mode "update"

* a table made from the same is left alone;
* of a table by day only the days whose rows differ are replaced, all others keep their files;
* what an interrupted run may have touched is not trusted: its days are marked before they are
  written, and a table without a manifest is written whole.

The manifest has one line per day of the calendar that holds rows, and is read by the driver.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parkpulse.functions.timeparts import in_days
from parkpulse.sources.sinks import write_table

MODES = ("error", "overwrite", "update")
#: Above this many changed days the table is written whole, as a filter that long plans slowly.
MOST_DAYS = 1000
_MANIFEST = "part string, content string, made_from string, shape string"
_UNTRUSTED = ""


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode()).hexdigest()


def _part(by: str | None) -> Column:
    return F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")


def contents(df: DataFrame, by: str | None = None) -> dict[str, str]:
    """Rows and two sums of 64-bit row hashes, per value of `by` or for all rows.

    Does not depend on the order or placing of rows; repeated rows count, and nulls count by place.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    sums = [
        F.sum(F.xxhash64(F.lit(seed), *columns, *[c.isNull() for c in columns]).cast("decimal(20,0)"))
        for seed in (1, 2)
    ]
    rows = df.groupBy(_part(by).alias("part")).agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    return {r.part: f"{r.n}:{r.s0}:{r.s1}" for r in rows.collect()}


@dataclass
class _State:
    """`whole` marks a write of the whole table, `made_from` is empty until it is complete."""

    made_from: str
    shape: str
    whole: bool
    parts: dict[str, str] = field(default_factory=dict)


class Tables:
    """Tables below a folder. `identity` tells the content of a kept table to those made from it."""

    def __init__(self, spark: SparkSession, out: str, mode: str = "error"):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.spark, self.out, self.mode = spark, out, mode
        self.written: list[str] = []
        self._identity: dict[str, str] = {}

    def identity(self, name: str) -> str:
        return self._identity[name]

    def keep(self, df: DataFrame, name: str, source: str, fmt: str = "parquet", by: str | None = None) -> DataFrame:
        """The table as written, read back. `source` says what it is made from: equal sources, equal rows."""
        shape = digest(fmt, by, df.schema.json())
        made_from = digest(name, shape, source)
        path = f"{self.out}/{name}"
        state = self._manifest(name) if self.mode == "update" else None
        if state is None or state.made_from != made_from:
            state = self._write(df, name, path, fmt, by, made_from, shape, state)
        self._identity[name] = digest(sorted(state.parts.items()))
        return self._read(df, path, fmt)

    def _write(
        self, df: DataFrame, name: str, path: str, fmt: str, by: str | None, made_from: str, shape: str, old: _State | None
    ) -> _State:
        if by and old and old.shape == shape and not (old.whole and not old.made_from):
            new = contents(df, by)
            changed = sorted(part for part, content in new.items() if old.parts.get(part) != content)
            if old.parts.keys() <= new.keys() and len(changed) <= MOST_DAYS:
                self._commit(name, _State("", shape, False, old.parts | dict.fromkeys(changed, _UNTRUSTED)))
                if changed:
                    write_table(df.where(_part(by).isin(changed)), path, fmt, by, "overwrite", only_found=True)
                    self.written.append(name)
                return self._commit(name, _State(made_from, shape, False, new))
        if self.mode == "error":
            write_table(df, path, fmt, by, "error")
        else:
            self._commit(name, _State("", shape, True))
            write_table(df, path, fmt, by, "overwrite")
        self.written.append(name)
        # A report is small and nothing is made from it, so what it was made from stands for its rows.
        parts = contents(self._read(df, path, fmt), by) if fmt == "parquet" else {"": made_from}
        return self._commit(name, _State(made_from, shape, True, parts))

    def _read(self, df: DataFrame, path: str, fmt: str) -> DataFrame:
        reader = self.spark.read.schema(df.schema)
        if fmt == "csv":
            reader = reader.option("header", True).option("escape", '"')
        return reader.format(fmt).load(path).select(*[f"`{c}`" for c in df.columns])

    def _commit(self, name: str, state: _State) -> _State:
        head = (None, "whole" if state.whole else "days", state.made_from, state.shape)
        lines = [head, *((part, content, None, None) for part, content in state.parts.items())]
        # As Arrow columns the lines need no Python worker.
        columns = [pa.array(column, pa.string()) for column in zip(*lines, strict=True)]
        table = self.spark.createDataFrame(pa.Table.from_arrays(columns, names=["part", "content", "made_from", "shape"]), _MANIFEST)
        table.coalesce(1).write.mode("overwrite").json(f"{self.out}/manifests/{name}")
        return state

    def _manifest(self, name: str) -> _State | None:
        try:
            lines = self.spark.read.schema(_MANIFEST).json(f"{self.out}/manifests/{name}").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        heads = [r for r in lines if r.part is None]
        if len(heads) != 1:
            return None
        parts = {r.part: r.content for r in lines if r.part is not None}
        return _State(heads[0].made_from, heads[0].shape, heads[0].content == "whole", parts)


def on_days(table: DataFrame, ts: str, by: str, first: str, last: str) -> DataFrame:
    """The rows of a table by day whose `ts` falls on these days, both included.

    `by` holds the day of `ts`, so the same range holds for it; said so, other folders are not listed
    for the scan. The result is that of the filter on `ts` alone.
    """
    day = F.col(by).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return table.where(day & in_days(F.col(ts), first, last))


def stays_touching(stays: DataFrame, first: str, last: str, longest_days: int) -> DataFrame:
    """Stays by day of arrival (`in_date`) that are under way at some time of these days.

    A stay that began earlier counts. `longest_days` bounds how many midnights a stay passes and is
    taken at its word for the folders read; `longest_stay` gives it for a written table.
    """
    lo = F.lit(first).cast("timestamp_ntz")
    hi = F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    folders = F.col("in_date").between(F.date_sub(F.lit(first).cast("date"), longest_days), F.lit(last).cast("date"))
    return stays.where(folders & (F.col("in_ts") < hi) & (F.col("out_ts") >= lo))


def longest_stay(stays: DataFrame) -> int:
    """The most midnights a stay passes; reads the two times only."""
    return stays.agg(F.coalesce(F.max(F.date_diff("out_ts", "in_ts")), F.lit(0)).alias("days")).first().days
