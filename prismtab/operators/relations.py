"""Correlations between numeric columns."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.coerce import number, numeric_columns
from prismtab.functions.rounding import half_up
from prismtab.operators.moments import co_moments
from prismtab.operators.profile import local_frame

PAIRS = "column_a string, column_b string, correlation double"
#: Up to this many columns one aggregate holds the moments of all pairs; beyond, blocks of rows are multiplied.
IN_ONE_AGGREGATE = 12


def _pearson(a: Column, b: Column) -> Column:
    """Null where a column is constant; the built-in function raises there under ANSI."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def _pairs(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Pearson correlation of every column pair over rows where both are filled.

    All pairs come from one scan: each task sends its moments, no data is shuffled.
    """
    names = numeric_columns(df) if columns is None else columns
    if len(names) < 2:
        return local_frame(df.sparkSession, [], PAIRS)
    if len(names) > IN_ONE_AGGREGATE:
        found = co_moments(df, names).correlation()
        rows = [(names[a], names[b], None if found[a, b] != found[a, b] else float(found[a, b])) for a, b in combinations(range(len(names)), 2)]
        return local_frame(df.sparkSession, rows, PAIRS)
    values = df.select(*[number(df, name).alias(f"c{i}") for i, name in enumerate(names)])
    pairs = list(combinations(range(len(names)), 2))
    row = values.agg(*[_pearson(F.col(f"c{a}"), F.col(f"c{b}")).alias(f"r{a}_{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(names[a]).alias("column_a"), F.lit(names[b]).alias("column_b"),
                 F.col(f"r{a}_{b}").alias("correlation"))
        for a, b in pairs
    ])))


def _strongest_first(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.desc(F.abs("correlation")), F.asc("column_a"), F.asc("column_b"))


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The upper half of the matrix; undefined correlations count as 0."""
    value = half_up(F.coalesce("correlation", F.lit(0.0)), 6)
    return _strongest_first(_pairs(df, columns).withColumn("correlation", value))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every ordered pair, ones on the diagonal: the rows of a heat map."""
    names = numeric_columns(df) if columns is None else columns
    upper = correlation_pairs(df, names)
    lower = upper.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation")
    diagonal = local_frame(df.sparkSession, [(n, n, 1.0) for n in names], PAIRS)
    return upper.unionByName(lower).unionByName(diagonal)


def strong_correlations(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.65) -> DataFrame:
    return correlation_pairs(df, columns).where(F.abs("correlation") >= threshold)


def driver_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns that take part in a strong correlation."""
    strong = strong_correlations(df, columns)
    return strong.select(F.explode(F.array("column_a", "column_b")).alias("column_name")).distinct()


def correlation_top(df: DataFrame, columns: list[str] | None = None, limit: int = 20) -> DataFrame:
    pairs = _pairs(df, columns).where(F.col("correlation").isNotNull())
    return _strongest_first(pairs.withColumn("correlation", half_up(F.col("correlation"), 4))).limit(limit)


def strength(value: Column) -> Column:
    size = F.abs(value)
    return F.when(size > 0.7, "strong").when(size > 0.4, "moderate").otherwise("weak")


def correlation_strength(df: DataFrame, columns: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Two-digit correlations with their strength in words."""
    pairs = _pairs(df, columns).where(F.col("correlation").isNotNull())
    rounded = pairs.withColumn("correlation", half_up(F.col("correlation"), 2))
    return _strongest_first(rounded.withColumn("strength", strength(F.col("correlation")))).limit(limit)
