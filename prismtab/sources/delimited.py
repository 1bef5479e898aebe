"""Delimited text: delimiter detection, ragged rows, number columns."""
from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prismtab.functions.coerce import col, numeric_text, text_columns
from prismtab.functions.names import clean_headers
from prismtab.sources.lines import WINDOWS, folder_encoding, has_text, read_lines, split_cells

# The delimiters looked for, the first one is the default.
DELIMITERS = ",;\t|"


def delimiters(lines: DataFrame) -> DataFrame:
    """(source, delimiter) from all (source, value) lines: the one that the most lines hold outside of
    quotes, then the one whose count varies least, then the most frequent one. Sources without any
    have no row."""
    pieces = F.filter(F.split("value", '"', -1), lambda _, i: i % 2 == 0)
    marks = F.array(*[F.struct(F.lit(-i).alias("rank"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)])
    counted = lines.select("source", F.array_join(pieces, "").alias("_bare"), F.inline(marks)).select(
        "source", "rank", "delimiter", (F.length("_bare") - F.length(F.replace("_bare", "delimiter"))).alias("n"))
    per_mark = counted.where("n > 0").groupBy("source", "rank", "delimiter").agg(
        F.count(F.lit(1)).alias("lines"), (F.min("n") - F.max("n")).alias("even"), F.sum("n").alias("cells"))
    return per_mark.groupBy("source").agg(
        F.max_by("delimiter", F.struct("lines", "even", "cells", "rank")).alias("delimiter"))


def folder_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of a folder of files, from one pass over all lines; files must not disagree."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value")
    found = sorted(r["delimiter"] for r in delimiters(lines).select("delimiter").distinct().collect())
    if len(found) > 1:
        raise ValueError(f"the files use different delimiters: {found}")
    return found[0] if found else DELIMITERS[0]


def read_delimited(
    spark: SparkSession, path: str, delimiter: str | None = None, schema: str | None = None,
    multiline: bool = False, encoding: str | None = None,
) -> DataFrame:
    """A folder of files in one of the known encodings with a header line. Give a schema to save the
    pass that infers it, an encoding to save the one that looks for it. ``multiline`` allows line
    breaks in quoted cells: records are put together in parallel, whatever the size of the files. Without
    a schema the columns of such files, and of files in code page 1252, are numbers or text."""
    delimiter = delimiter or folder_delimiter(spark, path)
    encoding = encoding or folder_encoding(spark, path)
    if multiline or encoding == WINDOWS:  # Spark's reader does not know that code page
        table = read_ragged(spark, path, delimiter)
        if schema is None:
            return table
        wanted = StructType.fromDDL(schema).fields
        if len(wanted) != len(table.columns):
            raise ValueError(f"the schema has {len(wanted)} columns, the files have {len(table.columns)}")
        return table.select(*(col(c).cast("string").try_cast(f.dataType).alias(f.name) for c, f in zip(table.columns, wanted)))
    reader = spark.read.option("header", True).option("sep", delimiter).option("mode", "PERMISSIVE").option("escape", '"')
    reader = reader.option("encoding", encoding)
    frame = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return non_empty(frame.toDF(*clean_headers(frame.columns)))


def read_ragged(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A folder of files in any of the known encodings whose rows may be too long or too short, and
    whose quoted cells may hold line breaks.

    The header is the first line with text of each file; every file must have the same one."""
    delimiter = delimiter or folder_delimiter(spark, path)
    lines = read_lines(spark, path, delimiter)
    filled = lines.where(has_text(F.col("value"), delimiter))
    heads = filled.groupBy("source").agg(
        F.min("line_no").alias("_head"), F.min_by("value", "line_no").alias("_header"))
    header = heads.select(F.min("_header")).first()[0]
    if header is None:
        raise ValueError("the files hold no rows")
    body = filled.join(heads, "source").where(F.col("line_no") > F.col("_head"))
    names = clean_headers(_driver_cells(header, delimiter))
    return promote_numeric(repair_lines(body, names, delimiter))


def _driver_cells(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter))


def repair_lines(lines: DataFrame, header: list[str], delimiter: str = ",") -> DataFrame:
    """Text columns from lines: blank lines go, surplus cells join the last column, missing cells
    and empty ones are null."""
    width = len(header)
    cells, size = F.col("_cells"), F.size("_cells")
    tail = F.array_join(F.slice(cells, width, F.greatest(size - width + 1, F.lit(0))), delimiter)
    fitted = F.when(size > width, F.concat(F.slice(cells, 1, width - 1), F.array(tail))).otherwise(
        F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(width) - size, F.lit(0)))))
    rows = lines.where(has_text(F.col("value"), delimiter)).select(
        split_cells(F.col("value"), delimiter).alias("_cells"))
    return rows.select(fitted.alias("_cells")).select(*[
        F.nullif(F.element_at("_cells", i + 1), F.lit("")).alias(name) for i, name in enumerate(header)])


def promote_numeric(df: DataFrame) -> DataFrame:
    """Text columns whose every non-null value is a number become numbers: whole ones bigint,
    or decimal(38,0) from 19 digits on."""
    texts = text_columns(df)
    if not texts:
        return df
    whole, longer = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?\d{1,38}\s*$"
    row = df.agg(*[
        count.alias(f"{i}_{part}") for i, name in enumerate(texts) for part, count in (
            ("filled", F.count(col(name))), ("numbers", F.count_if(numeric_text(col(name)))),
            ("whole", F.count_if(col(name).rlike(whole))), ("longer", F.count_if(col(name).rlike(longer))))
    ]).first()
    changes = {}
    for i, name in enumerate(texts):
        filled, numbers, wholes, longer_ones = (row[f"{i}_{part}"] for part in ("filled", "numbers", "whole", "longer"))
        if filled and numbers == filled:
            kind = "bigint" if wholes == filled else "decimal(38,0)" if longer_ones == filled else "double"
            changes[name] = F.trim(col(name)).cast(kind)
    return df.withColumns(changes) if changes else df


def cell_text(cell: Column) -> Column:
    """A report cell: null when blank, else trimmed."""
    return F.nullif(F.trim(cell), F.lit(""))


def cell_number(cell: Column) -> Column:
    """The number a report cell holds, if any."""
    return F.when(numeric_text(cell), F.trim(cell).cast("double"))


def non_empty(df: DataFrame) -> DataFrame:
    """Refuse a table without columns; a table with columns and no rows is fine."""
    if not df.columns:
        raise ValueError("the input has no columns")
    return df
