"""Text lines of a folder, decoded file by file."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.session import checkpointed
from prismtab.sources.records import whole_records

#: Stands for a delimiter outside quotes; a code point that no text may use.
CELL_END = "\ufdd0"
UTF8, WINDOWS, LATIN = "UTF-8", "windows-1252", "ISO-8859-1"
# Code page 1252 differs from Latin-1 in these bytes; five of them have no meaning in it.
_C1 = range(0x80, 0xA0)
_UNDEFINED = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
_LATIN = "".join(chr(b) for b in _C1 if b not in _UNDEFINED)
_WINDOWS = "".join(bytes([b]).decode("cp1252") for b in _C1 if b not in _UNDEFINED)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, value). Lines are ordered by `line_no` within a source: the start of the
    file block, then the position in it. Files of any size are split over tasks."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), place.alias("line_no"), "value")


def read_lines(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Lines as text; with a delimiter, records: lines that a quoted cell holds together are one value.

    Line numbers depend on how a scan was cut into tasks, so the lines are numbered once and written
    to the shared checkpoint folder; whatever compares numbers reads them from there."""
    lines = raw_lines(spark, path)
    found = checkpointed(lines) if delimiter is None else whole_records(lines, delimiter, in_order=True)
    encoded = F.col("encoding")
    text = F.when(encoded == UTF8, F.col("value").cast("string")).when(encoded == LATIN, _latin()).otherwise(
        F.translate(_latin(), _LATIN, _WINDOWS))
    # One row per file has the encoding.
    return found.join(encodings(found), "source").select("source", "line_no", _without_mark(text).alias("value"))


def encodings(lines: DataFrame) -> DataFrame:
    """(source, encoding): a file is UTF-8 if all of its lines are, else code page 1252, else Latin-1."""
    unknown = _latin().rlike("[" + "".join(chr(b) for b in sorted(_UNDEFINED)) + "]")
    return lines.groupBy("source").agg(
        F.when(F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))), UTF8).when(F.bool_or(unknown), LATIN).otherwise(WINDOWS).alias("encoding"))


def folder_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of a folder of files, from one pass over all lines; files must not disagree."""
    found = sorted(r["encoding"] for r in encodings(raw_lines(spark, path)).select("encoding").distinct().collect())
    if len(found) > 1:
        raise ValueError(f"the files use different encodings: {found}")
    return found[0] if found else UTF8


def _latin() -> Column:
    return F.decode(F.col("value").cast("binary"), LATIN)


def _without_mark(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def split_cells(line: Column, delimiter: str) -> Column:
    """The cells of one record; a quoted cell may hold the delimiter and doubled quotes. Lines whose quotes
    all enclose cells are cut at once; others, as with an inch mark in plain text, quote by quote."""
    even = _even_cells(line, delimiter)
    cells = F.when(F.exists(even, lambda c: ~_regular(c)), _stepped_cells(line, delimiter)).otherwise(even)
    return F.when(F.contains(line, F.lit('"')), F.transform(cells, _unquoted)).otherwise(F.split(line, "\\" + delimiter, -1))


def _even_cells(line: Column, delimiter: str) -> Column:
    """Cut at the quotes: a piece with an even number of quotes behind it lies outside of them."""
    pieces = F.split(line, '"', -1)
    cut = F.transform(pieces, lambda p, i: F.when(
        (F.size(pieces) - 1 - i) % 2 == 0, F.replace(p, F.lit(delimiter), F.lit(CELL_END))).otherwise(p))
    return F.split(F.array_join(cut, '"'), CELL_END, -1)


def _regular(cell: Column) -> Column:
    """Without quotes, or enclosed in quotes with only doubled ones inside."""
    bare = F.trim(cell)
    inner = F.replace(F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0))), F.lit('""'), F.lit(""))
    enclosed = (F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"')
    return ~F.contains(cell, F.lit('"')) | (enclosed & ~F.contains(inner, F.lit('"')))


#: What stands before a quote: nothing yet, a blank start of a cell, plain text, quoted text, or a quote that is
#: the first of two.
_FIRST, _START, _PLAIN, _QUOTED, _DOUBLED = range(5)


def _stepped_cells(line: Column, delimiter: str) -> Column:
    """The cells by a fold over the pieces between quotes: a quote opens a cell only where the cell starts."""
    pieces = F.transform(F.split(line, '"', -1), lambda p, i: F.struct(p.alias("text"), i.alias("at")))
    last = F.size(pieces) - 1

    def step(state: Column, piece: Column) -> Column:
        text, mode = piece["text"], state["mode"]
        blank = F.trim(F.substring_index(text, delimiter, -1)) == ""
        behind = F.when(blank, _START).otherwise(_PLAIN)
        moved = F.when(F.contains(text, F.lit(delimiter)), behind).otherwise(_PLAIN)
        now = (F.when(mode == _FIRST, behind).when((mode == _START) | (mode == _DOUBLED), _QUOTED)
               .when((mode == _QUOTED) & (text == "") & (piece["at"] < last), _DOUBLED).otherwise(moved))
        shown = F.when(now == _QUOTED, text).otherwise(F.replace(text, F.lit(delimiter), F.lit(CELL_END)))
        return F.struct(now.alias("mode"), F.concat(state["out"], F.when(mode == _FIRST, "").otherwise('"'), shown).alias("out"))

    start = F.struct(F.lit(_FIRST).alias("mode"), F.lit("").alias("out"))
    return F.split(F.aggregate(pieces, start, step, lambda s: s["out"]), CELL_END, -1)


def _unquoted(cell: Column) -> Column:
    bare = F.regexp_replace(F.regexp_extract(cell, r'(?s)^\s*"(.*)"\s*$', 1), '""', '"')
    return F.when(cell.rlike(r'(?s)^\s*".*"\s*$'), bare).otherwise(cell)


def has_text(line: Column, delimiter: str) -> Column:
    """Whether any cell of the line holds text; only odd lines need their cells split for that."""
    plain = line.rlike(f'[^\\s"\\{delimiter}]')
    return F.when(plain, F.lit(True)).otherwise(any_text(split_cells(line, delimiter)))


def any_text(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.trim(c) != "")
