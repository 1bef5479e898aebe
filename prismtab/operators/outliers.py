"""Interquartile outliers and histograms."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.coerce import col, number, numeric_columns
from prismtab.functions.rounding import half_up, half_up_value
from prismtab.operators.profile import local_frame, per_column
from prismtab.operators.quantiles import exact_quantiles


def iqr_bounds(
    df: DataFrame, columns: list[str] | None = None, skip_flat: bool = False,
) -> dict[str, tuple[float, float]]:
    """Lower and upper bound per column, 1.5 interquartile ranges beyond the quartiles.

    Columns without values have no bounds; ``skip_flat`` also leaves out columns with equal quartiles.
    """
    names = numeric_columns(df) if columns is None else columns
    bounds = {}
    for name, (low, high) in exact_quantiles(df, names, [0.25, 0.75]).items():
        if low is None or (skip_flat and high - low <= 0):
            continue
        bounds[name] = (low - 1.5 * (high - low), high + 1.5 * (high - low))
    return bounds


def outlier_counts(
    df: DataFrame, columns: list[str] | None = None, min_values: int = 0, skip_flat: bool = False,
) -> DataFrame:
    """Values, outliers and bounds per numeric column: quartiles first, then one counting pass."""
    bounds = iqr_bounds(df, columns, skip_flat)

    def outside(value: Column, name: str) -> Column:
        low, high = bounds[name]
        return (value < low) | (value > high)

    if not bounds:
        return local_frame(df.sparkSession, [], (
            "column_name string, values bigint, outliers bigint, lower_bound double, upper_bound double"))
    return per_column(df, list(bounds), {
        "values": lambda c, _: F.count(c),
        "outliers": lambda c, name: F.count_if(outside(c, name)),
        "lower_bound": lambda _, name: F.lit(bounds[name][0]),
        "upper_bound": lambda _, name: F.lit(bounds[name][1]),
    }).where(F.col("values") >= min_values)


def outliers_iqr(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Outlier counts of columns with at least four values."""
    return outlier_counts(df, columns, min_values=4).select(
        "column_name", "outliers", half_up(F.col("lower_bound"), 6).alias("lower_bound"),
        half_up(F.col("upper_bound"), 6).alias("upper_bound"))


def outliers_any_size(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Outlier counts without a floor on the number of values."""
    return outlier_counts(df, columns).select("column_name", "outliers")


def outliers_pct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns with outliers and a spread, with the share of outliers."""
    share = half_up(F.col("outliers") * 100.0 / F.col("values"), 2)
    return outlier_counts(df, columns, min_values=4, skip_flat=True).where(F.col("outliers") > 0).select(
        "column_name", "outliers", share.alias("outlier_pct"),
        half_up(F.col("lower_bound"), 2).alias("lower_bound"),
        half_up(F.col("upper_bound"), 2).alias("upper_bound"))


def outlier_samples(df: DataFrame, column: str, key: list[str], limit: int = 10) -> DataFrame:
    """The first outlier rows by key; Spark rows have no position, so a key stands in for it."""
    bounds = iqr_bounds(df, [column])
    if column not in bounds:
        return df.select(*map(col, key), col(column)).where(F.lit(False))
    low, high = bounds[column]
    value = number(df, column)
    return df.where((value < low) | (value > high)).select(*map(col, key), value.alias(column)).orderBy(
        *map(col, key), F.asc(column)).limit(limit)


def cap_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns pulled back to their bounds; nulls stay null."""
    def capped(value: Column, low: float, high: float) -> Column:
        # least and greatest skip nulls, so a null has to be kept apart.
        return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))

    bounds = iqr_bounds(df, columns)
    return df.withColumns({name: capped(number(df, name), *edges) for name, edges in bounds.items()})


# --- histograms --------------------------------------------------------------------------------


def _span(df: DataFrame, column: str):
    value = F.col("v")
    return df.select(number(df, column).alias("v")).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.count_if(F.pmod(value, F.lit(1.0)) != 0).alias("fractions")).first()


def _short_number(value: Column) -> Column:
    """Whole numbers without a point, others with up to two digits."""
    two = F.round(value.cast("decimal(38,12)"), 2)
    trimmed = F.regexp_replace(two.cast("string"), r"\.?0+$", "")
    whole = value.cast("decimal(38,0)").cast("string")
    return F.when(value == F.floor(value), whole).otherwise(trimmed)


def _bin_label(low: Column, high: Column) -> Column:
    return F.concat_ws("-", _short_number(low), _short_number(high))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Bins chosen by the data: whole non-negative numbers over at most 1200 get integer bins,
    everything else equal-width bins. Empty bins are left out."""
    span = _span(df, column)
    empty = "bin string, count bigint"
    if not span["n"]:
        return local_frame(df.sparkSession, [], empty)
    low, high = span["low"], span["high"]
    if low == high:
        one = df.sparkSession.range(1).select(_bin_label(F.lit(low), F.lit(high)).alias("bin"))
        return one.select("bin", F.lit(span["n"]).cast("bigint").alias("count"))
    if not span["fractions"] and low >= 0 and high - low <= 1200:
        return _integer_bins(df, column, int(low), high - low)
    bins = min(12, max(3, math.isqrt(span["n"])))
    return equal_width_counts(df, column, low, high, bins).select(
        _bin_label(F.col("low"), F.col("high")).alias("bin"), "count")


def _integer_bins(df: DataFrame, column: str, start: int, span: float) -> DataFrame:
    """Bins of whole numbers. Calories come in 60s, with a first bin that is one wider."""
    calories = "calorie" in column.lower()
    width = 60 if calories else max(1, math.ceil(span / 10))
    extra = 1 if calories else 0
    position = (number(df, column) - start).cast("bigint")
    bin_no = F.greatest(F.floor((position - extra) / width), F.lit(0))
    low = F.lit(start) + F.col("b") * width + F.when(F.col("b") > 0, extra).otherwise(0)
    high = F.lit(start) + (F.col("b") + 1) * width + extra - 1
    return (
        df.where(position.isNotNull()).select(bin_no.alias("b"))
        .groupBy("b").agg(F.count(F.lit(1)).alias("count")).orderBy("b")
        .select(F.concat_ws("-", low.cast("bigint").cast("string"), high.cast("bigint").cast("string"))
                .alias("bin"), "count")
    )


def equal_width_counts(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin_no, low, high, count) of equal-width bins; the last one includes the upper edge."""
    value = number(df, column)
    # width_bucket puts the top edge into bin n+1.
    bin_no = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    step = (high - low) / bins
    edge = lambda at: F.when(at == bins, F.lit(high)).otherwise(F.lit(low) + at * F.lit(step))
    return (
        df.where(value.isNotNull()).select(bin_no.alias("bin_no"))
        .groupBy("bin_no").agg(F.count(F.lit(1)).alias("count")).orderBy("bin_no")
        .select("bin_no", edge(F.col("bin_no") - 1).alias("low"), edge(F.col("bin_no")).alias("high"), "count")
    )


def histogram_summary(df: DataFrame, column: str) -> DataFrame:
    """Between 5 and 20 equal-width bins by the number of values; empty bins are kept."""
    span = _span(df, column)
    if not span["n"]:
        return local_frame(df.sparkSession, [], "bin_no int, low double, high double, count bigint")
    low, high = span["low"], span["high"]
    if low == high:  # a constant column gets bins half a unit to both sides
        low, high = low - 0.5, high + 0.5
    bins = min(20, max(5, span["n"] // 10))
    edges = [low + (high - low) / bins * i for i in range(bins)] + [high]
    rows = [(i + 1, half_up_value(edges[i], 1), half_up_value(edges[i + 1], 1)) for i in range(bins)]
    every = local_frame(df.sparkSession, rows, "bin_no int, low double, high double")
    counted = equal_width_counts(df, column, low, high, bins).select("bin_no", "count")
    return every.join(counted, "bin_no", "left").select(
        "bin_no", "low", "high", F.coalesce("count", F.lit(0)).alias("count")).orderBy("bin_no")
