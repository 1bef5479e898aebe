"""Rankings and group comparisons. Here rows without a label or value are dropped, not renamed."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismtab.functions.amounts import Amount, amount
from prismtab.functions.coerce import col, numeric_columns, timestamp
from prismtab.functions.periods import bucket, period_text
from prismtab.functions.rounding import half_up
from prismtab.operators.filters import since
from prismtab.operators.trends import filled_periods


def _lines(df: DataFrame, key: str, value: str, *more) -> DataFrame:
    lines = df.select(col(key).cast("string").alias("_key"), *amount(df, value).named("_value"), *more)
    return lines.where(F.col("_key").isNotNull() & Amount.of("_value").known())


def _totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("_key").agg(*Amount.of("_value").sum().named("_total"))


def rank_groups(
    df: DataFrame, dimension: str, value: str, limit: int = 10, ascending: bool = False,
    label_name: str | None = None, value_name: str | None = None,
) -> DataFrame:
    """Groups by summed value, the largest (or smallest) first."""
    total = Amount.of("_total")
    order = total.smallest_first() if ascending else total.largest_first()
    top = _totals(_lines(df, dimension, value)).orderBy(*order, F.asc("_key")).limit(limit)
    return top.select(F.col("_key").alias(label_name or dimension), total.shown().alias(value_name or value))


def trending(df: DataFrame, product: str, value: str, date: str, limit: int = 10) -> DataFrame:
    """Growth of the latest month over the month before it in the data.

    A light pass over the dates finds the two months; the second pass reads only rows from then on
    and puts both months side by side with conditional sums, so the months are never joined. With
    one month there is nothing to compare with: previous_revenue and growth_pct are null.
    """
    start = bucket(timestamp(df, date), "month").alias("_start")
    months = _lines(df, product, value, start).where(F.col("_start").isNotNull()).select("_start").distinct()
    latest = [r[0] for r in months.orderBy(F.desc("_start")).limit(2).collect()]
    if len(latest) < 2:
        names = {"recent_revenue": "recent_revenue", "previous_revenue": None, "growth_pct": None}
        ranked = rank_groups(df, product, value, limit).toDF(product, "recent_revenue")
        return ranked.select(col(product), *(F.col(c) if c else F.lit(None).cast("double").alias(n) for n, c in names.items()))
    recent, previous = latest

    def total(month) -> Amount:
        return Amount.of("_value").where(F.col("_start") == F.lit(month)).sum().or_zero()

    sides = (
        _lines(since(df, date, previous), product, value, start)
        .where(F.col("_start").isin(recent, previous))
        .groupBy("_key").agg(*total(recent).named("_recent"), *total(previous).named("_previous"))
    )
    now, before = Amount.of("_recent"), Amount.of("_previous")
    new, old = now.double(), before.double()
    growth = F.when(before.nonzero(), (new - old) / old * 100).when(now.nonzero(), 100.0).otherwise(0.0)
    return sides.select(
        F.col("_key").alias(product), now.shown().alias("recent_revenue"),
        before.shown().alias("previous_revenue"), half_up(growth, 1).alias("growth_pct"),
    ).orderBy(F.desc("growth_pct"), F.asc(product)).limit(limit)


def revenue_trend(df: DataFrame, date: str, value: str, grain: str = "month", value_name: str | None = None) -> DataFrame:
    """Summed value per calendar period; rows without a date or value are dropped."""
    lines = df.select(bucket(timestamp(df, date), grain).alias("_start"), *amount(df, value).named("_value"))
    total = Amount.of("_value")
    return (
        lines.where(F.col("_start").isNotNull() & total.known())
        .groupBy("_start").agg(*total.sum().named("_value")).orderBy("_start")
        .select(period_text(F.col("_start"), grain).alias("period"), total.shown().alias(value_name or value))
    )


def compare_groups(df: DataFrame, dimension: str, values: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Mean, sum and count of every value column per group; the groups with most values."""
    names = [n for n in numeric_columns(df) if n != dimension] if values is None else values
    lines = df.where(col(dimension).isNotNull()).select(
        col(dimension).alias(dimension), *[c for i, n in enumerate(names) for c in amount(df, n).named(f"v{i}")])
    grouped = lines.groupBy(dimension).agg(*[
        a for i in range(len(names)) for a in (
            *Amount.of(f"v{i}").sum().named(f"s{i}"), (F.count(f"v{i}") + F.count(f"v{i}_rest")).alias(f"n{i}"))
    ])
    last = f"n{len(names) - 1}"
    top = grouped.orderBy(F.desc(last), F.asc(dimension)).limit(limit)
    return top.select(dimension, *[
        c for i, n in enumerate(names) for c in (
            half_up(F.try_divide(Amount.of(f"s{i}").double(), F.col(f"n{i}").cast("double")), 2).alias(f"{n}_mean"),
            Amount.of(f"s{i}").or_zero().shown().alias(f"{n}_sum"),
            F.col(f"n{i}").alias(f"{n}_count"))
    ])


def best_and_worst(df: DataFrame, dimension: str, value: str) -> DataFrame:
    """The groups with the largest and smallest sum; no row with fewer than two groups."""
    total = Amount.of("_total")
    row = F.struct(F.col("_key").alias("key"), total.shown().alias("value"))
    # Ties go to the first label, so the label joins the ordering.
    first_last = _totals(_lines(df, dimension, value)).agg(
        F.count(F.lit(1)).alias("_groups"),
        F.min_by(row, F.struct((-total).rank_key(), F.col("_key"))).alias("_best"),
        F.min_by(row, F.struct(total.rank_key(), F.col("_key"))).alias("_worst"),
    )
    return first_last.where(F.col("_groups") >= 2).select(
        F.col("_best.key").alias("best_group"), F.col("_best.value").alias("best_value"),
        F.col("_worst.key").alias("worst_group"), F.col("_worst.value").alias("worst_value"))


def concentration(df: DataFrame, dimension: str, value: str, leaders: int = 3, above: float = 60.0) -> DataFrame:
    """Share of the leading groups when it is above the threshold, from five groups up."""
    total = Amount.of("_total")
    groups = _totals(_lines(df, dimension, value))
    whole = groups.agg(F.struct(total.sum().double().alias("total"), F.count(F.lit(1)).alias("groups")).alias("whole")).scalar()
    top = groups.orderBy(*total.largest_first(), F.asc("_key")).limit(leaders).agg(total.sum().double().alias("top"))
    share = half_up(F.col("top") / F.col("total") * 100, 1)
    return (
        top.select("top", whole.alias("whole")).select("top", "whole.total", "whole.groups")
        .where((F.col("total") > 0) & (F.col("groups") >= 5))
        .select("groups", share.alias("top_share_pct")).where(F.col("top_share_pct") > above)
    )


def recent_growth(df: DataFrame, date: str, value: str) -> DataFrame:
    """Average of the last three months against the first three, empty months counting as 0.

    No row with fewer than ten rows or three months, or when the first average is 0."""
    monthly = filled_periods(df, date, value, "month")
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("start"))
    marked = monthly.withColumns({"_n": n, "_at": at})  # one row per calendar month
    avg = lambda side: F.avg(F.when(side, F.col("total").cast("double")))
    ends = marked.agg(
        F.max("_n").alias("months"), F.max("lines").alias("lines"),
        avg(F.col("_at") > F.col("_n") - 3).alias("recent"), avg(F.col("_at") <= 3).alias("older"),
    )
    change = (F.col("recent") - F.col("older")) / F.abs("older") * 100
    return ends.where((F.col("lines") >= 10) & (F.col("months") >= 3) & (F.col("older") != 0)).select(
        "months", half_up(F.col("recent"), 2).alias("recent_avg"),
        half_up(F.col("older"), 2).alias("older_avg"), half_up(change, 1).alias("change_pct"))
