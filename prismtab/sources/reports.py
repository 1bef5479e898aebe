"""Report exports: a title, key and value lines, a summary, then the actual table.

The layout of each report is found with grouped minimums over its lines, so a report may have any
number of lines and one source may hold most of them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.session import checkpointed
from prismtab.sources.delimited import folder_delimiter, promote_numeric
from prismtab.sources.lines import has_text, read_lines, split_cells


def _rows(lines: DataFrame, delimiter: str) -> DataFrame:
    cells = F.transform(split_cells(F.col("value"), delimiter), lambda c: F.trim(c))
    filled = lines.where(has_text(F.col("value"), delimiter))
    return filled.select("source", "line_no", cells.alias("cells")).withColumn("width", F.size("cells"))


def report_rows(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """(source, line_no, header, cells) of the tables inside (source, line_no, value) lines.

    The table starts at the first line of the largest width whose cells are all filled and
    different and that has another line of that width after it; it ends at the first line of
    another width after its first row. Sources whose first line is as wide are plain tables and
    yield nothing here. The lines from the header on are written once."""
    rows = _rows(lines, delimiter)
    placed = _with_layout(rows, _layout(rows)).where(F.col("line_no") >= F.col("header_no"))
    placed = checkpointed(placed.select("source", "line_no", "cells", "width", "widest", "header_no"))
    wide, below = F.col("width") == F.col("widest"), F.col("line_no") > F.col("header_no")
    marks = checkpointed(placed.groupBy("source").agg(
        F.min(F.when(~below, F.col("cells"))).alias("header"),
        F.min(F.when(wide & below, F.col("line_no"))).alias("first_row")))
    after = placed.where(~wide & below).select("source", "line_no").join(
        marks.select("source", "first_row").hint("merge"), "source").where(F.col("line_no") > F.col("first_row"))
    ends = after.groupBy("source").agg(F.min("line_no").alias("end_no"))
    bounds = checkpointed(marks.hint("merge").join(ends, "source", "left"))
    table = placed.where(wide & below).join(bounds.hint("merge"), "source")
    return table.where(F.col("end_no").isNull() | (F.col("line_no") < F.col("end_no"))).select("source", "line_no", "header", "cells")


def _with_layout(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """The lines of the reports with the layout of their report. There may be as many reports as a table has rows, and
    Spark knows no size of lines cut out of other columns: both sides are sorted, none is sent to every task."""
    return rows.join(layout.hint("merge"), "source")


def _layout(rows: DataFrame) -> DataFrame:
    """(source, widest, header_no, summary_no): where the parts of each report lie, one row per report, from one pass, written once."""
    named = F.transform(F.filter("cells", lambda c: c != ""), F.lower)
    distinct_cells = F.size(F.array_distinct(named)) == F.col("width")
    is_summary = (F.col("width") == 1) & (F.lower(F.col("cells")[0]) == "summary")
    # One row per source and line width.
    widths = rows.groupBy("source", "width").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last"),
        F.min(F.when(distinct_cells, F.col("line_no"))).alias("header_no"),
        F.min(F.when(is_summary, F.col("line_no"))).alias("summary_no"))
    layout = widths.groupBy("source").agg(
        F.max("width").alias("widest"), F.min_by("width", "first").alias("first_width"),
        F.max_by("header_no", "width").alias("header_no"), F.max_by("last", "width").alias("last"),
        F.min("summary_no").alias("summary_no"))
    above = F.when(F.col("summary_no") < F.col("header_no"), F.col("summary_no"))
    return checkpointed(layout.where(
        (F.col("widest") >= 2) & (F.col("first_width") != F.col("widest")) & (F.col("header_no") < F.col("last"))
    ).select("source", "widest", "header_no", above.alias("summary_no")))


def report_facts(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """(source, section, key, value) from the key and value lines above the tables.

    Lines after the word Summary belong to the summary, others to the metadata; a repeated key
    keeps its last value. The first line of one cell that is not that word is the report title."""
    rows = _rows(lines, delimiter)
    key, value, number = F.col("cells")[0], F.element_at("cells", -1), F.col("line_no")
    # Titles and pairs are grouped together, so the lines are read and sorted once for both.
    titled = (F.col("width") == 1) & (F.lower(key) != "summary")
    facts = rows.where((F.col("width") == 2) | titled).select(
        "source", "line_no", (F.col("width") == 1).alias("titled"), key.alias("key"), value.alias("value"))
    above = _with_layout(facts, _layout(rows)).where(number < F.col("header_no"))
    section = F.when(~F.col("titled") & (number > F.col("summary_no")), "summary").otherwise("metadata")
    found = above.groupBy("source", "titled", section.alias("section"), F.when(~F.col("titled"), F.col("key")).alias("key")).agg(
        F.min_by("value", "line_no").alias("first"), F.max_by("value", "line_no").alias("last"))
    return found.select("source", "section", F.when(F.col("titled"), "report_title").otherwise(F.col("key")).alias("key"),
                        F.when(F.col("titled"), F.col("first")).otherwise(F.col("last")).alias("value"))


def detail_table(detail: DataFrame, header: list[str]) -> DataFrame:
    """Report rows as a table by the names of the header; number columns become numbers."""
    by_name = F.map_from_arrays("header", "cells")
    frame = detail.select("source", "line_no", by_name.alias("_row")).select(
        "source", "line_no", *[F.col("_row")[name].alias(name) for name in header])
    return promote_numeric(frame)


def read_report_lines(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The records of a folder of reports and their delimiter."""
    delimiter = folder_delimiter(spark, path)
    return read_lines(spark, path, delimiter), delimiter


def headers(detail: DataFrame) -> list[list[str]]:
    """The different table headers in a set of reports."""
    return [r["header"] for r in detail.select("header").distinct().collect()]
