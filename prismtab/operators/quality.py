"""Data quality: missing values, duplicates, describe tables, quality scores and warnings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.coerce import col, is_null, numeric_columns, text_columns
from prismtab.functions.rounding import half_up, half_up_value, percent
from prismtab.operators.filters import preview
from prismtab.operators.outliers import outlier_counts, outliers_iqr
from prismtab.operators.profile import (
    ColumnStats, cardinality, categorical_top_values, column_stats, local_frame, per_column, skewness,
    top_values, value_counts,
)
from prismtab.operators.quantiles import exact_quantiles


def row_counts(df: DataFrame, fingerprint: bool = False) -> DataFrame:
    """One row: rows, distinct rows, duplicates; nulls equal each other.

    The default groups whole rows and is exact. ``fingerprint`` groups 128 hash bits instead, which
    shuffles 16 bytes per row of a wide table; two different rows share one with a chance of about
    n^2 / 10^38.
    """
    keys: list[Column] = [col(name) for name in df.columns]
    if fingerprint:
        nulls = [c.isNull() for c in keys]  # the hash skips nulls, so say where they are
        keys = [F.xxhash64(*nulls, *keys).alias("_h1"), F.xxhash64(F.lit("other"), *nulls, *keys).alias("_h2")]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"),
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def duplicate_rows(df: DataFrame, fingerprint: bool = False) -> DataFrame:
    return row_counts(df, fingerprint).select("total_rows", "duplicate_rows")


def duplicate_count(df: DataFrame, fingerprint: bool = False) -> int:
    return row_counts(df, fingerprint).first()["duplicate_rows"]


def _missing(df: DataFrame) -> DataFrame:
    """(column_name, missing, rows) from one aggregate without a shuffle of rows."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(is_null(df, name)).alias(f"c{i}") for i, name in enumerate(df.columns)])
    return row.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(f"c{i}").alias("missing"))
        for i, name in enumerate(df.columns)
    ])))


def missing_values(df: DataFrame) -> DataFrame:
    return _missing(df).select("column_name", "missing")


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values, most first, with the share and a flag above 30%."""
    share = percent(F.col("missing"), F.greatest("_rows", F.lit(1)), 2)
    return (
        _missing(df).where(F.col("missing") > 0)
        .select("column_name", "missing", share.alias("missing_pct"))
        .withColumn("needs_attention", F.col("missing_pct") > 30)
        .orderBy(F.desc("missing"), F.asc("column_name"))
    )


def missing_share(df: DataFrame, above: float = 5.0) -> DataFrame:
    """Share of missing cells; no row when it is not above the threshold."""
    cells = F.sum("missing").alias("missing_cells"), F.sum("_rows").alias("cells")
    share = percent(F.col("missing_cells"), F.greatest("cells", F.lit(1)), 1)
    return _missing(df).agg(*cells).select("missing_cells", "cells", share.alias("missing_pct")).where(
        F.col("missing_pct") > above)


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, completeness."""
    missing = _missing(df).agg(F.sum("missing").alias("missing_cells"), F.max("_rows").alias("total_rows"))
    cells = F.col("total_rows") * len(df.columns)
    return missing.select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"), "missing_cells",
        half_up(100 - F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, cells), F.lit(0.0)), 2)
        .alias("completeness_pct"),
    )


def quality_assessment(df: DataFrame) -> DataFrame:
    """(check, column, value) rows: missing values, duplicates, completeness, outlier counts."""
    counts = [(r["column_name"], r["missing"], r["_rows"]) for r in _missing(df).collect()]  # one row per column
    rows, nulls = max((n for _, _, n in counts), default=0), sum(missing for _, missing, _ in counts)
    found = [("missing_pct", name, half_up_value(missing / rows * 100, 1)) for name, missing, _ in counts if missing]
    found += [("missing_count", name, float(missing)) for name, missing, _ in counts if missing]
    found.append(("total_missing", "", float(nulls)))
    found.append(("duplicate_rows", "", float(duplicate_count(df))))
    if rows:
        found.append(("completeness_pct", "", half_up_value((1 - nulls / (rows * len(counts))) * 100, 1)))
    summary = local_frame(df.sparkSession, found, "check string, column_name string, value double")
    outliers = outlier_counts(df, skip_flat=True).where(F.col("outliers") > 0).select(
        F.lit("outliers").alias("check"), "column_name", F.col("outliers").cast("double").alias("value"))
    return summary.unionByName(outliers)


def describe_numeric(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per numeric column; quartiles are exact."""
    names = numeric_columns(df) if columns is None else columns
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])

    def quartile(position: int):
        return lambda _, name: half_up(F.lit(quartiles[name][position]).cast("double"), digits)

    return per_column(df, names, {
        "count": lambda c, _: F.count(c),
        "mean": lambda c, _: half_up(F.avg(c), digits),
        "std": lambda c, _: half_up(F.stddev_samp(c), digits),
        "min": lambda c, _: half_up(F.min(c), digits),
        "p25": quartile(0), "p50": quartile(1), "p75": quartile(2),
        "max": lambda c, _: half_up(F.max(c), digits),
    })


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct count, most common value and its frequency per text column (ties by value)."""
    counts = value_counts(df, text_columns(df) if columns is None else columns)
    leader = top_values(counts, 1).select(
        "column_name", F.col("value").alias("most_common"), F.col("count").alias("frequency"))
    distinct = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_values"))
    return distinct.join(leader, "column_name")


def kind_of(stats: ColumnStats) -> str:
    if stats.kind == "number":
        return "numeric"
    if stats.date_like_for_trends:
        return "date"
    return "categorical" if stats.distinct <= max(20, int(stats.rows * 0.2)) else "text"


def column_kinds(df: DataFrame, stats: list[ColumnStats] | None = None) -> DataFrame:
    rows = [(s.name, kind_of(s)) for s in stats or column_stats(df)]
    return local_frame(df.sparkSession, rows, "column_name string, kind string")


def quality_facts(stats: list[ColumnStats], duplicates: int) -> dict[str, float]:
    """The numbers behind the quality score, from the shared statistics."""
    rows, cells = (stats[0].rows if stats else 0), sum(s.rows for s in stats)
    missing = sum(s.nulls for s in stats)
    missing_pct = half_up_value(missing / max(1, cells) * 100, 4)
    duplicate_pct = half_up_value(duplicates / max(1, rows) * 100, 4)
    constant = sum(s.distinct <= 1 for s in stats)
    many = sum(s.kind != "number" and s.distinct / max(1, rows) >= 0.7 for s in stats)
    score = 100 - missing_pct - min(25.0, duplicate_pct) - 2 * constant - many
    return {
        "row_count": rows, "column_count": len(stats), "missing_cells": missing,
        "missing_pct": missing_pct, "duplicate_rows": duplicates, "duplicate_pct": duplicate_pct,
        "constant_columns": constant, "high_cardinality_columns": many,
        "data_quality_score": half_up_value(min(100.0, max(0.0, score)), 2),
    }


def data_quality(df: DataFrame, stats: list[ColumnStats] | None = None) -> DataFrame:
    facts = quality_facts(stats or column_stats(df), duplicate_count(df))
    return local_frame(df.sparkSession, [tuple(facts.values())], (
        "row_count bigint, column_count bigint, missing_cells bigint, missing_pct double, "
        "duplicate_rows bigint, duplicate_pct double, constant_columns bigint, "
        "high_cardinality_columns bigint, data_quality_score double"))


def profile_score(stats: list[ColumnStats], duplicates: int) -> float:
    """The profile's own score; blanks count as missing here."""
    rows, cells = (stats[0].rows if stats else 0), sum(s.rows for s in stats)
    missing = sum(s.blanks for s in stats)
    holes = sum(s.blanks / max(1, s.rows) >= 0.3 for s in stats)
    many = sum(s.cardinality in ("high", "very_high") for s in stats)
    share = 1 - (missing / cells if cells else 0) - duplicates / max(1, rows) - 0.02 * holes - 0.01 * many
    return half_up_value(min(100.0, max(0.0, share * 100)), 1)


def profile_quality_score(df: DataFrame, stats: list[ColumnStats]) -> DataFrame:
    duplicates = duplicate_count(df)
    row = (profile_score(stats, duplicates), duplicates, sum(s.blanks for s in stats), sum(s.rows for s in stats))
    return local_frame(df.sparkSession, [row], (
        "score double, duplicate_rows bigint, total_missing bigint, total_cells bigint"))


def dataset_warnings(df: DataFrame, stats: list[ColumnStats], quality: list[ColumnStats] | None = None) -> DataFrame:
    """(source, warning) rows of the profile and of the quality report."""
    duplicates = duplicate_count(df)
    facts = quality_facts(quality or stats, duplicates)
    rows = stats[0].rows if stats else 0
    checks = [
        ("profile", "too_few_rows", rows < 20),
        ("profile", "missing_values_present", any(s.blanks for s in stats)),
        ("profile", "duplicate_rows_present", duplicates > 0),
        ("profile", "no_date_column", not any(s.date_like for s in stats)),
        ("profile", "no_numeric_column", not any(s.kind == "number" for s in stats)),
        ("profile", "high_cardinality_columns", any(s.cardinality in ("high", "very_high") for s in stats)),
        ("quality", "missing_values_present", facts["missing_cells"] > 0),
        ("quality", "duplicate_rows_present", duplicates > 0),
        ("quality", "constant_columns_present", facts["constant_columns"] > 0),
        ("quality", "high_cardinality_columns_present", facts["high_cardinality_columns"] > 0),
        ("quality", "too_few_rows_for_modeling", rows < 10),
    ]
    return local_frame(df.sparkSession, [(a, b) for a, b, holds in checks if holds],
                       "source string, warning string")


def dataset_overview(df: DataFrame, dataset_type: str) -> DataFrame:
    """Rows, columns and detected type as (metric, value) text rows."""
    counted = df.agg(F.count(F.lit(1)).cast("string").alias("rows"))
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in (
            ("Rows", F.col("rows")), ("Columns", F.lit(str(len(df.columns)))),
            ("Dataset type", F.lit(dataset_type)))
    ])))


def analysis_summary(df: DataFrame, kpis: DataFrame) -> DataFrame:
    """Row, column, missing and duplicate counts followed by the known business totals."""
    facts = completeness(df).join(duplicate_rows(df), "total_rows").select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"))
        for name, column in (("Rows", "total_rows"), ("Columns", "total_columns"),
                             ("Missing Cells", "missing_cells"), ("Duplicate Rows", "duplicate_rows"))
    ])))
    totals = kpis.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(column).alias("value"))
        for name, column in (("Total Revenue", "total_revenue"), ("Total Quantity", "total_quantity"),
                             ("Total Profit", "total_profit"), ("Gross Margin", "gross_margin"))
    ]))).where(F.col("value").isNotNull())
    return facts.unionByName(totals)


def eda_bundle(df: DataFrame, key: str | None = None) -> dict[str, DataFrame]:
    """The exploratory tables in one call, sharing one statistics pass."""
    stats = column_stats(df)
    labels = [s.name for s in stats if kind_of(s) in ("categorical", "text")]
    bundle = {
        "missing_values": missing_values(df),
        "duplicates": duplicate_rows(df),
        "cardinality": cardinality(df, stats),
    }
    if labels:
        bundle["top_values"] = categorical_top_values(df, labels)
    if numeric_columns(df):
        bundle |= {"describe": describe_numeric(df), "skewness": skewness(df), "outliers": outliers_iqr(df)}
    if key:
        bundle["preview"] = preview(df, key)
    return bundle
