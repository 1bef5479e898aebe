"""One entry for a folder of tables, whatever their form."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.sources.delimited import read_ragged
from prismtab.sources.lines import has_text
from prismtab.sources.reports import detail_table, headers, read_report_lines, report_rows
from prismtab.sources.spreadsheets import read_spreadsheets


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks, sectioned reports or delimited text in any of the known encodings, also with rows that
    are too long or too short. The files of a folder must be of one form and have one header."""
    files = spark.read.format("binaryFile").load(path).select(F.lower("path").endswith(".xlsx").alias("book"))
    forms = {r["book"] for r in files.distinct().collect()}
    if len(forms) > 1:
        raise ValueError("the folder holds workbooks and other files")
    if forms == {True}:
        return read_spreadsheets(spark, path)
    lines, delimiter = read_report_lines(spark, path)
    detail = report_rows(lines, delimiter)
    plain = lines.where(has_text(F.col("value"), delimiter)).select("source").distinct()
    if headers(detail) and plain.join(detail.select("source").distinct(), "source", "left_anti").limit(1).count():
        raise ValueError("the folder holds reports and plain tables")
    found = headers(detail)
    if len(found) > 1:
        raise ValueError(f"the reports have {len(found)} different headers")
    return detail_table(detail, found[0]).drop("source", "line_no") if found else read_ragged(spark, path, delimiter)
