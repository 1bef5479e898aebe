"""Business metrics: KPIs, period and dimension roll-ups, growth.

Money is summed as decimals, so results are the same on any number of tasks; amounts too large for
them are kept as doubles beside them (see ``functions.amounts``). Every operator also
accepts a frame that was already summed per key (see ``plans.views.sales_totals``): pass the name
of the column with the number of source rows as ``rows``.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismtab.functions.amounts import Amount, amount, product, zero
from prismtab.functions.coerce import col, label, timestamp, upper_trim
from prismtab.functions.periods import bucket, period_text
from prismtab.functions.rounding import half_up


@dataclass(frozen=True)
class Metric:
    """How one metric is read from a row.

    A plain column; a product of two columns (``column`` times ``times``); or an amount whose sign
    depends on a type column: ``include`` words add, ``subtract`` words take away, others count 0.
    """

    column: str
    times: str | None = None
    type_column: str | None = None
    include: tuple[str, ...] = ()
    subtract: tuple[str, ...] = ()


def metric_amount(df: DataFrame, metric: Metric) -> Amount:
    """The metric of a row; what is no number counts 0."""
    value = amount(df, metric.column)
    if metric.times:
        return product(value, amount(df, metric.times))
    value = value.or_zero()
    if not metric.type_column:
        return value
    kind = upper_trim(col(metric.type_column))
    signs = [(words, sign) for words, sign in ((metric.subtract, -value), (metric.include, value)) if words]
    exact = F.coalesce(*(F.when(kind.isin(*words), sign.exact) for words, sign in signs), zero())
    taken = F.coalesce(*(F.when(kind.isin(*words), F.lit(i)) for i, (words, _) in enumerate(signs)), F.lit(-1))
    rest = F.coalesce(*(F.when(taken == i, sign.rest) for i, (_, sign) in enumerate(signs)), F.lit(None).cast("double"))
    return Amount(exact, rest)


def _row_count(rows: str | None) -> Column:
    return F.coalesce(F.sum(col(rows)), F.lit(0)).cast("bigint") if rows else F.count(F.lit(1))


def _sale_count(metric: Metric, rows: str | None) -> Column:
    if not metric.type_column or not metric.include:
        return _row_count(rows)
    counted = upper_trim(col(metric.type_column)).isin(*metric.include)
    weight = col(rows) if rows else F.lit(1)
    return F.coalesce(F.sum(F.when(counted, weight).otherwise(0)), F.lit(0)).cast("bigint")


def totals(df: DataFrame, metrics: dict[str, Metric], rows: str | None = None) -> DataFrame:
    """Unrounded totals of the given metrics in one aggregate; metrics not given are null."""
    known = ("revenue", "quantity", "cost", "expense", "profit")
    none = Amount(F.lit(None).cast("decimal(28,4)"), F.lit(None).cast("double"))
    sums = [c for name in known for c in (metric_amount(df, metrics[name]).sum().or_zero() if name in metrics else none).named(name)]
    sales = _sale_count(metrics["revenue"], rows) if "revenue" in metrics else _row_count(rows)
    base = df.agg(*sums, _row_count(rows).alias("transactions"), sales.alias("sales"))
    if "profit" in metrics:
        return base
    # A cost of exactly 0 falls through to the expense.
    cost, expense = Amount.of("cost"), Amount.of("expense")
    profit = Amount.of("revenue") - cost.where(cost.nonzero()).otherwise(expense).otherwise(cost)
    return base.drop("profit", "profit_rest").select("*", *profit.named("profit"))


def business_kpis(df: DataFrame, metrics: dict[str, Metric], rows: str | None = None) -> DataFrame:
    """One row: totals, margin, order counts, average order value."""
    base = totals(df, metrics, rows)
    revenue, profit = Amount.of("revenue").double(), Amount.of("profit").double()
    return base.select(
        Amount.of("revenue").shown().alias("total_revenue"),
        Amount.of("quantity").shown().alias("total_quantity"),
        Amount.of("cost").shown().alias("total_cost"),
        Amount.of("expense").shown().alias("total_expenses"),
        Amount.of("profit").shown().alias("total_profit"),
        half_up(F.try_divide(profit, revenue) * 100, 4).alias("gross_margin"),
        half_up(F.try_divide(revenue, F.col("sales").cast("double")), 2).alias("average_order_value"),
        F.col("transactions").alias("transaction_count"),
        F.col("sales").alias("sales_transaction_count"),
    )


def average_order_value(df: DataFrame, revenue: Metric, rows: str | None = None) -> DataFrame:
    kpis = business_kpis(df, {"revenue": revenue}, rows)
    return kpis.select("total_revenue", "sales_transaction_count", "average_order_value")


def _labelled(frame: DataFrame, pairs: list[tuple[str, Column]], key: str) -> DataFrame:
    """Turn a one-row frame into (key, value) rows without a second aggregate."""
    items = F.array(*[
        F.struct(F.lit(name).alias(key), value.cast("double").alias("value")) for name, value in pairs
    ])
    return frame.select(F.inline(items))


def kpi_cards(df: DataFrame, metrics: dict[str, Metric], rows: str | None = None) -> DataFrame:
    kpis = business_kpis(df, metrics, rows)
    return _labelled(kpis, [
        ("Total Sales", F.col("total_revenue")),
        ("Total Quantity", F.col("total_quantity")),
        ("Total Profit", F.col("total_profit")),
        ("Gross Margin", F.col("gross_margin")),
        ("Transactions", F.col("transaction_count")),
    ], "label")


def profit_summary(df: DataFrame, metrics: dict[str, Metric], rows: str | None = None) -> DataFrame:
    kpis = business_kpis(df, metrics, rows)
    return _labelled(kpis, [
        ("total_revenue", F.col("total_revenue")),
        ("total_cost_or_expense", F.coalesce(F.col("total_cost"), F.col("total_expenses"))),
        ("total_profit", F.col("total_profit")),
        ("gross_margin_pct", half_up(F.col("gross_margin"), 2)),
    ], "metric")


def business_overview(df: DataFrame, metrics: dict[str, Metric], rows: str | None = None) -> DataFrame:
    kpis = business_kpis(df, metrics, rows)
    names = ("total_revenue", "total_quantity", "total_profit", "transaction_count")
    return _labelled(kpis, [(name, F.col(name)) for name in names], "metric")


def metric_by_period(
    df: DataFrame, date: str, metric: Metric, grain: str = "month",
    label_name: str = "period", value_name: str = "revenue",
) -> DataFrame:
    """Metric per calendar period in order; rows without a usable date are left out."""
    start = F.col("_start")
    return (
        df.select(bucket(timestamp(df, date), grain).alias("_start"), *metric_amount(df, metric).named("_value"))
        .where(start.isNotNull())
        .groupBy("_start").agg(*Amount.of("_value").sum().named("_value"))
        .orderBy("_start")
        .select(period_text(start, grain).alias(label_name), Amount.of("_value").shown().alias(value_name))
    )


def metric_by_dimension(
    df: DataFrame, dimension: str, metric: Metric, label_name: str | None = None,
    value_name: str = "revenue", limit: int = 20,
) -> DataFrame:
    """Largest groups first. The limit applies before groups of exactly 0 are taken out."""
    key = label_name or dimension_label(dimension)
    top = (
        df.groupBy(label(df, dimension).alias(key))
        .agg(*metric_amount(df, metric).sum().named("_value"))
        .orderBy(*Amount.of("_value").largest_first(), F.asc(key)).limit(limit)
    )
    return top.where(Amount.of("_value").nonzero()).select(key, Amount.of("_value").shown().alias(value_name))


def dimension_label(column: str) -> str:
    """Output label for a grouped column, chosen from the words in its name."""
    name = column.lower().replace(" ", "_")
    # Label and the words that select it, first match wins.
    words = [
        ("product", ("product", "item", "sku")),
        ("category", ("category",)),
        ("customer", ("customer", "client", "buyer")),
        ("region", ("region", "city", "country")),
        ("store", ("store", "branch", "shop")),
    ]
    return next((key for key, tokens in words if any(t in name for t in tokens)), column)


def count_by_dimension(
    df: DataFrame, dimension: str, label_name: str, count_name: str = "transaction_count",
    limit: int = 20, rows: str | None = None,
) -> DataFrame:
    return (
        df.groupBy(label(df, dimension).alias(label_name)).agg(_row_count(rows).alias(count_name))
        .orderBy(F.desc(count_name), F.asc(label_name)).limit(limit)
    )


def expense_by_group(df: DataFrame, expense: Metric, group: str | None) -> DataFrame:
    """Expense per group, largest first, zero groups left out; one total when there is no group."""
    value = metric_amount(df, expense).sum()
    if group is None:
        return df.agg(value.or_zero().shown().alias("expense")).select(
            F.lit("expenses").alias("expense_type"), "expense")
    total = Amount.of("_value")
    return (
        df.groupBy(label(df, group).alias("expense_type")).agg(*value.named("_value"))
        .where(total.nonzero()).orderBy(*total.largest_first(), F.asc("expense_type"))
        .select("expense_type", total.shown().alias("expense"))
    )


def _monthly_for_leaders(df: DataFrame, date: str, product: str, revenue: Metric, leaders: int) -> DataFrame:
    """(product, _start, _value, _value_rest) of the leading products from one pass over the table.

    Monthly sums travel with their product, so the ranking needs no second pass and no join; a
    product has at most one entry per calendar month. Rows without a date count for the ranking."""
    lines = df.select(
        bucket(timestamp(df, date), "month").alias("_start"),
        label(df, product).alias("product"),
        *metric_amount(df, revenue).named("_value"),
    )
    value, total = Amount.of("_value"), Amount.of("_total")
    monthly = lines.groupBy("product", "_start").agg(*value.sum().named("_value"))
    top = (
        monthly.groupBy("product")
        .agg(*value.sum().named("_total"), F.collect_list(F.struct("_start", "_value", "_value_rest")).alias("_months"))
        .orderBy(*total.largest_first(), F.asc("product")).limit(leaders).where(total.nonzero())
    )
    return top.select("product", F.inline("_months")).where(F.col("_start").isNotNull())


def top_product_monthly(
    df: DataFrame, date: str, product: str, revenue: Metric, leaders: int = 5,
) -> DataFrame:
    monthly = _monthly_for_leaders(df, date, product, revenue, leaders)
    return (
        monthly.where(Amount.of("_value").nonzero()).orderBy("_start", "product")
        .select(period_text(F.col("_start"), "month").alias("period"), "product",
                Amount.of("_value").shown().alias("revenue"))
    )


def product_growth(
    df: DataFrame, date: str, product: str, revenue: Metric, leaders: int = 5,
) -> DataFrame:
    """First against last period of the leading products; empty when there is one period only."""
    monthly = _monthly_for_leaders(df, date, product, revenue, leaders)
    # At most `leaders` products times the calendar months reach this window.
    whole = Window.partitionBy(F.lit(0))
    marked = monthly.withColumns({
        "_first": F.min("_start").over(whole), "_last": F.max("_start").over(whole)})

    def at(edge: str) -> Amount:
        return Amount.of("_value").where(F.col("_start") == F.col(edge)).sum().or_zero()

    ends = (
        marked.where(F.col("_first") < F.col("_last"))
        .groupBy("product").agg(*at("_first").named("_a"), *at("_last").named("_b"))
    )
    first, last = Amount.of("_a"), Amount.of("_b")
    return ends.select(
        "product",
        first.shown().alias("first_period_revenue"),
        last.shown().alias("last_period_revenue"),
        (last - first).shown().alias("absolute_growth"),
        half_up(F.try_divide((last - first).double(), F.abs(first.double())) * 100, 2).alias("pct_growth"),
    ).orderBy(F.desc("absolute_growth"), F.asc("product"))


def growing_products(growth: DataFrame, limit: int = 10) -> DataFrame:
    return growth.where(F.col("absolute_growth") > 0).orderBy(
        F.desc("absolute_growth"), F.asc("product")).limit(limit)


def declining_products(growth: DataFrame, limit: int = 10) -> DataFrame:
    """Shrinking products, the smallest loss first."""
    return growth.where(F.col("absolute_growth") < 0).orderBy(
        F.desc("absolute_growth"), F.asc("product")).limit(limit)


def growth_table(growth: DataFrame, limit: int = 10) -> DataFrame:
    """Growing products, or the declining ones when nothing grows."""
    # `growth` holds the few leading products, so this window is small.
    grows = F.max((F.col("absolute_growth") > 0).cast("int")).over(Window.partitionBy(F.lit(0)))
    return (
        growth.withColumn("_any", grows)
        .where(((F.col("_any") == 1) & (F.col("absolute_growth") > 0))
               | ((F.col("_any") == 0) & (F.col("absolute_growth") < 0)))
        .drop("_any").orderBy(F.desc("absolute_growth"), F.asc("product")).limit(limit)
    )


def revenue_share(df: DataFrame, dimension: str, metric: Metric, label_name: str, limit: int = 8) -> DataFrame:
    """The leading groups with their share of the positive values shown."""
    shown = metric_by_dimension(df, dimension, metric, label_name, limit=10).orderBy(
        F.desc("revenue"), F.asc(label_name)).limit(limit)
    positive = F.greatest(F.col("revenue"), F.lit(0.0))
    total = F.sum(positive).over(Window.partitionBy(F.lit(0)))
    return shown.select(
        label_name, "revenue", half_up(F.coalesce(F.try_divide(positive * 100, total), F.lit(0.0)), 1)
        .alias("share_pct"))


# Fixed labels.
TOP_CATEGORY, TOP_REGION = "Top category by revenue", "Top region by revenue"


def total_sales_overview(df: DataFrame, category: str, region: str, revenue: Metric) -> DataFrame:
    """The leading category and region of a table that holds both. Both rankings come from one aggregate."""
    sides = df.select(
        label(df, category).alias("_category"), label(df, region).alias("_region"),
        *metric_amount(df, revenue).named("_value"),
    ).groupBy("_category", "_region").agg(*Amount.of("_value").sum().named("_value"))
    pairs = F.array(
        F.struct(F.lit(TOP_CATEGORY).alias("metric"), F.col("_category").alias("value"), "_value", "_value_rest"),
        F.struct(F.lit(TOP_REGION).alias("metric"), F.col("_region").alias("value"), "_value", "_value_rest"),
    )
    return _leaders(sides.select(F.inline(pairs)))


def leading_values(sums: DataFrame, revenue: Metric) -> DataFrame:
    """The same from (metric, value) sums, as a star gives them without a wide table."""
    return _leaders(sums.select("metric", label(sums, "value").alias("value"), *metric_amount(sums, revenue).named("_value")))


def _leaders(sums: DataFrame) -> DataFrame:
    total = Amount.of("_value")
    ranked = (
        sums.groupBy("metric", "value").agg(*total.sum().named("_value"))
        .withColumn("_rank", F.row_number().over(
            Window.partitionBy("metric").orderBy(*total.largest_first(), F.asc("value"))))
    )
    return ranked.where((F.col("_rank") == 1) & total.nonzero()).select(
        "metric", "value", total.shown().alias("amount"))
