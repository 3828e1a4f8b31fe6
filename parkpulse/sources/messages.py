"""Reading message files: workbooks, CSV or Parquet, one file or many."""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parkpulse.sources.workbook import FILE, PLACE, read_workbooks

# The columns of a message file and their names here.
COLUMNS = {"센서": "sensor", "센서값": "payload", "송신일시(sendDate)": "send_ts"}
# The root of a path, written with one slash or with several.
ROOT = "^([a-z0-9]+):/+"
FORMATS = ("xlsx", "csv", "parquet")


def file_format(path: str) -> str:
    """Format by file extension; anything but a known extension is refused."""
    extension = PurePosixPath(path.rstrip("/")).suffix.lstrip(".").lower()
    if extension not in FORMATS:
        raise ValueError(f"cannot tell the format of {path!r}; expected one of {FORMATS}")
    return extension


def read_messages(
    spark: SparkSession, path: str, fmt: str | None = None, sample: str | None = None
) -> DataFrame:
    """Raw messages (row_id, sensor, payload, send_ts).

    `path` may be a file, a folder or a glob; folders need `fmt`. Without a path the `sample`
    data set is read. The row id orders rows by file name, then by place in the file, however the
    files are split and dealt to tasks.
    """
    path = path or sample
    if not path:
        raise ValueError("no message file given")
    fmt = fmt or file_format(path)
    if fmt == "xlsx":
        table = read_workbooks(spark, path, tuple(COLUMNS))
    elif fmt == "csv":
        table = spark.read.option("header", True).option("escape", '"').csv(path)
        # Rows of a task are numbered in order, and there are fewer of them than bytes in a split.
        number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        table = _with_place(table, F.col("_metadata.file_block_start") + number)
    elif fmt == "parquet":
        table = spark.read.parquet(path)
        table = _with_place(table, F.col("_metadata.row_index"))
    else:
        raise ValueError(f"format must be one of {FORMATS}")
    return as_messages(_with_file_number(table))


def _with_place(table: DataFrame, place: Column) -> DataFrame:
    # A path in the metadata is an encoded URI, in which a plus sign stands for itself.
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return table.select("*", file.alias(FILE), place.alias(PLACE))


def _with_file_number(table: DataFrame) -> DataFrame:
    """Add the row id: the number of the file in order of names, and the place in it.

    The names come from the file listing; the table of numbers has one row per file.
    """
    spark = table.sparkSession
    names = sorted({re.sub(ROOT, r"\1:/", unquote(f)) for f in table.inputFiles()})
    numbers = spark.createDataFrame(list(enumerate(names)), "number bigint, file string")
    key = F.regexp_replace(FILE, ROOT, "$1:/")
    row_id = F.shiftleft("number", 44) + F.col(PLACE)
    return table.join(numbers, key == F.col("file")).withColumn("row_id", row_id)


def as_messages(table: DataFrame) -> DataFrame:
    missing = [c for c in COLUMNS if c not in table.columns]
    if missing:
        raise ValueError(f"message columns missing: {missing}")
    return table.select(
        F.col("row_id") if "row_id" in table.columns else F.monotonically_increasing_id().alias("row_id"),
        *[F.col(f"`{c}`").alias(name) for c, name in COLUMNS.items()],
    )
