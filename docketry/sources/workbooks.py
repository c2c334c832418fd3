"""Spreadsheet workbooks as a Spark source: one task per workbook, every cell as text.

A workbook is bounded by its format (1,048,576 rows a sheet), so one task per file is a
bounded piece of work; Spark spreads the files.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SHEET = "xl/worksheets/sheet1.xml"
STRINGS = "xl/sharedStrings.xml"


def _column(ref: str) -> int:
    """Zero-based column of a cell reference such as 'AB12'."""
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _texts(el) -> str:
    return "".join(t.text or "" for t in el.iter(NS + "t"))


def _rows(book: zipfile.ZipFile) -> Iterator[tuple[int, dict[int, str]]]:
    """(sheet row number, {column: text}) of every row element; empty cells are left out."""
    shared: list[str] = []
    if STRINGS in book.namelist():
        with book.open(STRINGS) as f:
            for _, el in iterparse(f):
                if el.tag == NS + "si":
                    shared.append(_texts(el))
                    el.clear()
    with book.open(SHEET) as f:
        for _, el in iterparse(f):
            if el.tag != NS + "row":
                continue
            cells = {}
            for i, c in enumerate(el.iter(NS + "c")):
                kind, v = c.get("t", "n"), c.find(NS + "v")
                if kind == "inlineStr":
                    value = _texts(c)
                elif v is None or not v.text:
                    continue
                else:
                    value = shared[int(v.text)] if kind == "s" else v.text
                if value != "":
                    cells[_column(c.get("r")) if c.get("r") else i] = value
            yield int(el.get("r", 0)), cells
            el.clear()


def _filled_rows(book: zipfile.ZipFile) -> Iterator[tuple[int, bool]]:
    """(sheet row number, any value) of every row element. It reads no cell values, so it can
    check the row source."""
    with book.open(SHEET) as f:
        for _, el in iterparse(f):
            if el.tag == NS + "row":
                marks = (NS + "v", NS + "t")
                yield int(el.get("r", 0)), any(x.text for x in el.iter() if x.tag in marks)
                el.clear()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.key = options.get("key")
        self.names = schema.fieldNames()

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with zipfile.ZipFile(partition.path) as book:
            rows = _rows(book)
            _, head = next(rows)
            place = {name: i for i, name in head.items()}
            lost = [n for n in self.names if n not in place and n != "source_file"]
            if lost:
                raise KeyError(f"{partition.path}: header lacks {lost}")
            file = partition.path.rsplit("/", 1)[-1]
            key = place.get(self.key) if self.key else None
            for _, cells in rows:
                # Formatted but empty rows are dropped where they are read.
                if (key is not None and key not in cells) or not cells:
                    continue
                yield tuple(file if n == "source_file" else cells.get(place[n]) for n in self.names)


class WorkbookSource(DataSource):
    """format("workbook"): options `paths` (newline separated) and `key` (required column)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def reader(self, schema):
        return _Reader(self.options, schema)


def read_workbooks(
    spark: SparkSession, paths: list[str], columns: list[str], key: str | None = None
) -> DataFrame:
    """The named columns of the workbooks' first sheets, as text, with their file names.

    Only rows with a value in `key` are kept. Files must be on storage every executor sees
    as a path.
    """
    spark.dataSource.register(WorkbookSource)
    schema = ", ".join(f"`{c}` string" for c in [*columns, "source_file"])
    reader = spark.read.format("workbook").schema(schema).option("paths", "\n".join(paths))
    return (reader.option("key", key) if key else reader).load()


COUNT_SCHEMA = (
    "path string, header array<string>, data_rows bigint, blank_rows bigint, "
    "last_data_row bigint, first_blank_row bigint"
)


def count_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """Per workbook: header, data rows and blank rows, counted apart from the row source."""

    def count(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = blank = last = 0
                first_blank = None
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    _, head = next(_rows(book))
                    header = [head.get(i, "") for i in range(max(head, default=-1) + 1)]
                    for r, filled in _filled_rows(book):
                        if r == 1:
                            continue
                        if filled:
                            data, last = data + 1, r
                        else:
                            blank += 1
                            first_blank = first_blank or r
                out.append((path, header, data, blank, last, first_blank))
            frame = pd.DataFrame(
                out,
                columns=["path", "header", "data_rows", "blank_rows", "last_data_row", "first_blank_row"],
            )
            frame["first_blank_row"] = frame["first_blank_row"].astype("Int64")
            yield frame

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(count, COUNT_SCHEMA)


def staged_mismatches(counts: DataFrame, staged: DataFrame) -> DataFrame:
    """Files whose staged rows are not the independently counted rows."""
    from docketry.operators.quality import count_mismatches

    expected = counts.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("data_rows").alias("rows")
    )
    actual = staged.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    return count_mismatches(expected, actual, "source_file")
