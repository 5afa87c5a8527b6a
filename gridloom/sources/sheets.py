"""Spreadsheets (.xlsx) as rows: Spark lists and reads the files, each is taken apart in a task, from the XML in its archive."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StructType, TimestampType, _parse_datatype_string

#: Rows that are handed on together.
_ROWS = 10_000


def _local(tag: str) -> str:
    """A tag without its namespace, which differs between writers."""
    return tag.rsplit("}", 1)[-1]


def _texts(node: ElementTree.Element) -> str:
    """All runs of a string, but for phonetic guides."""
    return "".join(t.text or "" for part in node if _local(part.tag) in ("t", "r") for t in ([part] if _local(part.tag) == "t" else [x for x in part if _local(x.tag) == "t"]))


def _place(ref: str) -> int:
    """The column of a cell's name, from 0: A1 is 0, AA7 is 26."""
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _sheet(book: zipfile.ZipFile, name: str | None) -> tuple[str, bool]:
    """The archive's path of a sheet (the first, or by name), and whether dates count from 1904."""
    top = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [x for x in top.iter() if _local(x.tag) == "sheet"]
    found = next((x for x in sheets if name is None or x.get("name") == name), None)
    if found is None:
        raise ValueError(f"no sheet named {name}")
    link = next(v for k, v in found.attrib.items() if _local(k) == "id" and k != "sheetId")
    target = next(x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if x.get("Id") == link)
    early = any(_local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in top.iter())
    return (target.lstrip("/") if target.startswith("/") else f"xl/{target}"), early


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, dict[int, str], bool]]:
    """Row number, cells by column (as text; numbers as the file has them), and whether dates count from 1904.  Rows are read one by one."""
    with zipfile.ZipFile(BytesIO(content)) as book:
        path, early = _sheet(book, sheet)
        shared = [_texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        with book.open(path) as file:
            number = 0
            for _, node in ElementTree.iterparse(file):
                if _local(node.tag) != "row":
                    continue
                number = int(node.get("r", number + 1))
                cells: dict[int, str] = {}
                at = -1
                for cell in node:
                    at = _place(cell.get("r")) if cell.get("r") else at + 1
                    kind = cell.get("t", "n")
                    value = next((x for x in cell if _local(x.tag) in ("v", "is")), None)
                    if value is None or kind == "e":
                        continue
                    text = _texts(value) if kind == "inlineStr" else value.text
                    text = shared[int(text)] if kind == "s" and text is not None else text
                    if text not in (None, ""):
                        cells[at] = text
                yield number, cells, early
                node.clear()


def _typed(name: str, kind: object) -> Column:
    """A cell's text as its column's type, null where it is none; a date may be the number of its day."""
    text = F.col(name)
    if isinstance(kind, (DateType, TimestampType)):
        first = F.when(F.col("_early"), F.lit("1904-01-01")).otherwise(F.lit("1899-12-30")).cast("date")
        serial = F.expr(f"try_cast(`{name}` as double)")
        day = F.date_add(first, F.floor(serial).cast("int"))
        if isinstance(kind, DateType):
            return F.when(serial.isNotNull(), day).otherwise(F.expr(f"try_cast(`{name}` as date)"))
        return F.when(serial.isNotNull(), F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + F.round((serial - F.floor(serial)) * 86400))).otherwise(F.expr(f"try_cast(`{name}` as timestamp)"))
    if kind.simpleString() == "string":
        return text
    plain = F.expr(f"try_cast(`{name}` as {kind.simpleString()})")
    if not isinstance(kind, IntegralType):
        return plain
    # Writers may put whole numbers down as 27.0.
    number = F.expr(f"try_cast(`{name}` as double)")
    return F.coalesce(plain, F.when(number == F.floor(number), F.expr(f"try_cast(try_cast(`{name}` as double) as {kind.simpleString()})")))


def read_sheets(spark: SparkSession, path: str | list[str], schema: str | StructType, *, sheet: str | None = None, titles: int = 2, names: dict[str, str] | None = None) -> DataFrame:
    """Rows of the .xlsx files under a path, with the columns of ``schema`` and _file and _row.

    The first row names the columns (``names`` may give a column's name in the file); ``titles`` rows below it, of titles and units, go.
    Columns that the schema doesn't name are left out; one that a file lacks, an empty cell, and one that isn't of the column's type are
    null; rows without any cell go.  Files are read by Spark, so from any store, and a file is taken apart in one task,
    row by row: the format bounds a sheet to some million rows.  A file that is no archive of a workbook is an error.
    """
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    wanted = {f.name: (names or {}).get(f.name, f.name) for f in schema.fields}
    kinds = [("_file", pa.string()), ("_row", pa.int64()), ("_early", pa.bool_()), *[(n, pa.string()) for n in wanted]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at: dict[str, int] | None = None
                rows = []
                for k, (number, cells, early) in enumerate(sheet_rows(content.as_py(), sheet)):
                    if at is None:
                        at = {text.strip(): i for i, text in cells.items()}
                    elif k > titles and cells:
                        rows.append((file, number, early, *[cells.get(at.get(n, -1)) for n in wanted.values()]))
                    if len(rows) >= _ROWS:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    cells = files.mapInArrow(run, ", ".join(f"`{n}` {'long' if n == '_row' else 'boolean' if n == '_early' else 'string'}" for n, _ in kinds))
    return cells.select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema.fields], "_file", "_row")


def last_of_files(rows: DataFrame) -> DataFrame:
    """Of rows that repeat a date and code the last: of the last file by name, and of its last row."""
    others = [c for c in rows.columns if c not in ("date", "code", "_file", "_row")]
    return rows.groupBy("date", "code").agg(F.max_by(F.struct(*others), F.struct("_file", "_row")).alias("x")).select("date", "code", "x.*")
