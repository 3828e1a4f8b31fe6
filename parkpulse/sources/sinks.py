"""Writing tables and reports."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application below `spark.checkpoint.dir`, which all executors share.

    Only a local session in which that is unset (tests) uses the temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = Path(tempfile.gettempdir()).as_uri()
    return f"{base.rstrip('/')}/parkpulse-{spark.sparkContext.applicationId}/{name}"


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None, mode: str = "error", only_found: bool = False
) -> None:
    """Write `df`; with `by`, into one folder per value.

    Rows of one value are brought together first, so a folder holds few files; adaptive execution
    splits a value that is too large for one task. What is at `path` already is only replaced with
    mode "overwrite", with `only_found` only the folders of values that `df` holds.
    """
    if by:
        df = df.hint("rebalance", by)
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if by:
        writer = writer.partitionBy(by).option("partitionOverwriteMode", "dynamic" if only_found else "static")
    writer.format(fmt).save(path)
