"""Workbooks as a Spark source: Spark lists and distributes the files, a task reads the first
sheet of each. A sheet holds at most 1,048,576 rows, so one file always fits one task."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

FILE, PLACE = "source_file", "source_place"
BATCH_ROWS = 20_000
_TIME_FORMAT = "%Y-%m-%d %H:%M:%S"


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(book: zipfile.ZipFile, member: str, wanted: str) -> Iterator:
    """Stream the elements of one kind; each is freed after use."""
    with book.open(member) as part:
        for _, element in iterparse(part):
            if _name(element.tag) == wanted:
                yield element
                element.clear()


def _text(element) -> str:
    """Text of all runs, without phonetic guides."""
    parts = []
    for child in element:
        if _name(child.tag) == "t":
            parts.append(child.text or "")
        elif _name(child.tag) == "r":
            parts.extend(t.text or "" for t in child if _name(t.tag) == "t")
    return "".join(parts)


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = next(_elements(book, "xl/workbook.xml", "sheet"))
    relation = next(v for k, v in sheet.attrib.items() if _name(k) == "id")
    for link in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship"):
        if link.get("Id") == relation:
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("workbook has no sheet")


def _epoch(book: zipfile.ZipFile) -> datetime:
    for props in _elements(book, "xl/workbook.xml", "workbookPr"):
        if props.get("date1904") in ("1", "true"):
            return datetime(1904, 1, 1)
    return datetime(1899, 12, 30)


def _column(reference: str | None, position: int) -> int:
    """Zero-based column of a cell reference such as AB12."""
    if not reference:
        return position
    index = 0
    for ch in reference:
        if not ch.isalpha():
            break
        index = index * 26 + ord(ch.upper()) - 64
    return index - 1


def sheet_rows(content: bytes) -> Iterator[dict[int, str | float]]:
    """Cells of each row of the first sheet, by column; numbers stay numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(si) for si in _elements(book, "xl/sharedStrings.xml", "si")]
        for row in _elements(book, _first_sheet(book), "row"):
            cells: dict[int, str | float] = {}
            at = -1
            for cell in row:
                at = _column(cell.get("r"), at + 1)
                kind = cell.get("t", "n")
                inside = {_name(c.tag): c for c in cell}
                if kind == "inlineStr" and "is" in inside:
                    cells[at] = _text(inside["is"])
                elif "v" in inside and inside["v"].text is not None:
                    value = inside["v"].text
                    if kind == "s":
                        cells[at] = shared[int(value)]
                    else:
                        cells[at] = float(value) if kind == "n" else value
            yield cells


def _as_text(value, is_time: bool, epoch: datetime) -> str | None:
    if isinstance(value, float):
        if is_time:
            return (epoch + timedelta(seconds=round(value * 86_400))).strftime(_TIME_FORMAT)
        return f"{value:g}" if value != int(value) else str(int(value))
    return value


def read_workbooks(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The named columns of every workbook under `path` as text, with its file and place in it.

    Times stored as serial numbers are written out. A file without one of the columns fails.
    """
    time_column = columns[-1]

    def batches(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in files:
            for name, content in zip(frame["path"], frame["content"]):
                rows = sheet_rows(content)
                header = {v: k for k, v in next(rows, {}).items()}
                missing = [c for c in columns if c not in header]
                if missing:
                    raise ValueError(f"{name}: columns missing: {missing}")
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    epoch = _epoch(book)
                batch: list[list] = []
                for place, cells in enumerate(rows):
                    if not cells:
                        continue
                    values = [_as_text(cells.get(header[c]), c == time_column, epoch) for c in columns]
                    batch.append([*values, name, place])
                    if len(batch) == BATCH_ROWS:
                        yield pd.DataFrame(batch, columns=[*columns, FILE, PLACE])
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=[*columns, FILE, PLACE])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = StructType([StructField(c, StringType()) for c in (*columns, FILE)])
    schema.add(PLACE, LongType())
    return files.mapInPandas(batches, schema)
