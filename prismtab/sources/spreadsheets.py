"""The first sheet of .xlsx files. A sheet has at most 1,048,576 rows, so a file fits one task; its rows
leave the task in pieces of bounded size.

Numbers whose format shows a date become dates, as do cells written as ISO dates; booleans become
booleans and error cells are null. A column gets such a type when all of its filled cells have it.
"""
from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.functions.coerce import col
from prismtab.functions.names import clean_headers
from prismtab.sources.delimited import promote_numeric

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PIECE_ROWS = 5_000
# Fixed values of the file format: the built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_TEXT, _NUMBER, _DATE, _BOOLEAN, _ERROR = "text", "number", "date", "boolean", "error"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The name of its part, and whether dates count from 1904."""
    workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
    wanted = workbook.find(f"{_NS}sheets/{_NS}sheet").get(_REL)
    settings = workbook.find(f"{_NS}workbookPr")
    since_1904 = settings is not None and settings.get("date1904") in ("1", "true")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", since_1904


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{_NS}numFmt")}
    dates = _DATE_FORMATS | {number for number, code in own.items() if shows_date(code)}
    plain = {number for number, code in own.items() if not shows_date(code)}
    used = styles.find(f"{_NS}cellXfs")
    return {i for i, style in enumerate(used if used is not None else ()) if int(style.get("numFmtId") or 0) in dates - plain}


def shows_date(code: str) -> bool:
    """Whether a number format has a letter of a date or time outside of quoted text, colours and escapes."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower().split(";")[0])
    return bool(re.search(r"[ymdhs]", bare.replace("general", "")))


def date_text(serial: float, since_1904: bool) -> str | None:
    """A day count as date text. Counts below 60 are one day short, as the format knows a 29 February 1900."""
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31 if serial < 60 else 30)
    try:
        when = start + timedelta(days=int(serial // 1), seconds=round(serial % 1 * 86400))
    except OverflowError:
        return None
    return when.strftime("%Y-%m-%d %H:%M:%S")


def _sheet_rows(content: bytes) -> Iterator[tuple[list[str | None], list[str | None]]]:
    """(values, kinds) of the rows, as the file is read."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            strings = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in strings]
        name, since_1904 = _first_sheet(book)
        dates = _date_styles(book)
        with book.open(name) as sheet:
            table = None
            for event, element in ElementTree.iterparse(sheet, events=("start", "end")):
                if event == "start":
                    table = element if element.tag == f"{_NS}sheetData" else table
                    continue
                if element.tag != f"{_NS}row":
                    continue
                values: list[str | None] = []
                kinds: list[str | None] = []
                for cell in element.iter(f"{_NS}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(values)
                    missing = [None] * (at + 1 - len(values))
                    values += missing
                    kinds += missing
                    values[at], kinds[at] = _cell_value(cell, shared, dates, since_1904)
                yield values, kinds
                if table is not None:
                    table.clear()


def _cell_value(cell: ElementTree.Element, shared: list[str], dates: set[int], since_1904: bool) -> tuple[str | None, str | None]:
    form = cell.get("t") or "n"
    if form == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_NS}t")), _TEXT
    value = cell.find(f"{_NS}v")
    if value is None or value.text is None:
        return None, None
    text = value.text
    if form == "s":
        return shared[int(text)], _TEXT
    if form == "b":
        return "true" if text.strip() == "1" else "false", _BOOLEAN
    if form == "e":
        return None, _ERROR
    if form == "d":
        return text.replace("T", " ").removesuffix("Z"), _DATE
    if form == "n" and int(cell.get("s") or 0) in dates:
        shown = date_text(float(text), since_1904)
        return (shown, _DATE) if shown else (text, _NUMBER)
    return text, _NUMBER if form == "n" else _TEXT


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for source, content in zip(batch["path"], batch["content"]):
            rows: list[tuple] = []
            for number, (values, kinds) in enumerate(_sheet_rows(content)):
                rows.append((source, number, values, kinds))
                if len(rows) == PIECE_ROWS:
                    yield pd.DataFrame(rows, columns=["source", "row_no", "cells", "kinds"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["source", "row_no", "cells", "kinds"])


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(source, row_no, cells, kinds) of every file, one file at a time per task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(
        _parse, "source string, row_no bigint, cells array<string>, kinds array<string>")


def read_spreadsheets(spark: SparkSession, path: str) -> DataFrame:
    """A folder of workbooks with the same header row; number, date and boolean columns get their types."""
    rows = sheet_rows(spark, path)
    header = rows.where(F.col("row_no") == 0).orderBy("source").limit(1).select("cells").first()
    if header is None:
        raise ValueError("the files hold no rows")
    names = clean_headers([c or "" for c in header["cells"]])
    body = rows.where((F.col("row_no") > 0) & F.exists("cells", lambda c: c.isNotNull()))
    filled = [F.count_if(F.get("cells", F.lit(i)) != "").alias(f"n{i}") for i in range(len(names))]
    counts = [F.count_if(F.get("kinds", F.lit(i)) == kind).alias(f"{kind}{i}") for kind in (_DATE, _BOOLEAN) for i in range(len(names))]
    seen = body.agg(*filled, *counts).first()
    typed = {name: kind for i, name in enumerate(names) for mark, kind in ((_DATE, "timestamp"), (_BOOLEAN, "boolean"))
             if seen[f"n{i}"] and seen[f"{mark}{i}"] == seen[f"n{i}"]}
    table = promote_numeric(body.select(*[
        F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(names)]))
    return table.withColumns({name: col(name).try_cast(kind) for name, kind in typed.items()})
