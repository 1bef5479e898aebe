"""Catalogs (menus and the like): frequencies and number ranges instead of sales."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.functions.coerce import col
from prismtab.functions.rounding import half_up
from prismtab.operators.profile import per_column, top_values
from prismtab.operators.quantiles import exact_quantiles

# The columns a catalog is described by.
CATALOG_COLUMNS = ["food_name", "category", "cuisine", "main_ingredient", "spice_level"]


def catalog_frequency(df: DataFrame, columns: list[str] | None = None, limit: int = 20) -> DataFrame:
    """The most frequent trimmed values per column; nulls and blanks are dropped."""
    names = columns or [c for c in df.columns if c.lower() in CATALOG_COLUMNS]
    trimmed = df.select(*[F.trim(col(n).cast("string")).alias(n) for n in names])
    counts = (
        trimmed.unpivot([], [col(n) for n in names], "column_name", "value")
        .where(F.col("value") != "").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    )
    return top_values(counts, limit).select("column_name", "value", "count")


def catalog_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    medians = exact_quantiles(df, columns, [0.5])
    return per_column(df, columns, {
        "min": lambda c, _: half_up(F.min(c), 2),
        "max": lambda c, _: half_up(F.max(c), 2),
        "mean": lambda c, _: half_up(F.avg(c), 2),
        "median": lambda c, name: half_up(F.lit(medians[name][0]).cast("double"), 2),
    })
