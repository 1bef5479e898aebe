"""Income and expense summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.functions.amounts import Amount, amount
from prismtab.functions.coerce import col
from prismtab.operators.ranking import revenue_trend


def expense_summary(df: DataFrame, expense: str, category: str | None, limit: int = 10) -> DataFrame:
    """Expense per category, largest first; rows without a category are left out. Without a
    category column, one total."""
    spent, total = amount(df, expense).or_zero().sum(), Amount.of("_value")
    if category is None:
        return df.agg(spent.or_zero().shown().alias("total_expense")).select(
            F.lit("All expenses").alias("category"), "total_expense")
    return (
        df.where(col(category).isNotNull()).groupBy(col(category).cast("string").alias("category"))
        .agg(*spent.named("_value")).orderBy(*total.largest_first(), F.asc("category")).limit(limit)
        .select("category", total.shown().alias("total_expense"))
    )


def income_expense(df: DataFrame, income: str, expense: str) -> DataFrame:
    sums = df.agg(*(c for name, column in (("income", income), ("expense", expense)) for c in amount(df, column).sum().or_zero().named(name)))
    earned, spent = Amount.of("income"), Amount.of("expense")
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.shown().alias("amount")) for name, value in (
            ("income", earned), ("expense", spent), ("net", earned - spent))
    ])))


def monthly_trend(df: DataFrame, date: str, value: str) -> DataFrame:
    return revenue_trend(df, date, value, "month")
