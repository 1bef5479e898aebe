"""Ledger tables: one amount column whose meaning depends on the transaction type."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.functions.amounts import Amount, amount, currency_amount
from prismtab.functions.coerce import col, timestamp, upper_trim
from prismtab.functions.periods import bucket, period_text
from prismtab.functions.rounding import half_up
from prismtab.functions.vocabulary import LEDGER_CREDIT, LEDGER_EXPENSE, LEDGER_SALES


@dataclass(frozen=True)
class LedgerColumns:
    date: str
    kind: str
    item: str
    amount: str


def category_rows(df: DataFrame, columns: LedgerColumns, category: str) -> DataFrame:
    """Rows of one transaction type; amounts that are no number count 0 in the added columns: amount_value, and
    amount_value_rest for amounts too large for it."""
    return df.where(upper_trim(col(columns.kind)) == category.upper()).select(
        "*", *amount(df, columns.amount).or_zero().named("amount_value"))


def _sum_of(df: DataFrame, columns: LedgerColumns, category: str) -> Amount:
    return amount(df, columns.amount).where(upper_trim(col(columns.kind)) == category).sum().or_zero()


def _stated(summary: DataFrame | None) -> dict[str, str]:
    """The summary lines of a report: a handful of key and value pairs."""
    if summary is None:
        return {}
    wanted = ["Total Sales", "Total Expenses", "Udhaar Outstanding", "Net Profit", "Profit Status"]
    return {r["key"]: r["value"] for r in summary.where(F.col("key").isin(wanted)).select("key", "value").collect()}


def ledger_summary(df: DataFrame, columns: LedgerColumns, report_summary: DataFrame | None = None) -> DataFrame:
    """Totals and counts per type in one aggregate. Values stated in the report win over computed ones."""
    stated = _stated(report_summary)

    def known(key: str, computed: Amount) -> Amount:
        return currency_amount(F.lit(stated.get(key)).cast("string")).otherwise(computed)

    kind = upper_trim(col(columns.kind))
    base = df.agg(
        *_sum_of(df, columns, LEDGER_SALES).named("_sales"), *_sum_of(df, columns, LEDGER_EXPENSE).named("_expenses"),
        *_sum_of(df, columns, LEDGER_CREDIT).named("_credit"), F.count(F.lit(1)).alias("transaction_count"),
        F.count_if(kind == LEDGER_SALES).alias("sales_transaction_count"),
        F.count_if(kind == LEDGER_EXPENSE).alias("expense_transaction_count"),
        F.count_if(kind == LEDGER_CREDIT).alias("credit_transaction_count"),
    )
    sales, expenses = known("Total Sales", Amount.of("_sales")), known("Total Expenses", Amount.of("_expenses"))
    credit, profit = known("Udhaar Outstanding", Amount.of("_credit")), known("Net Profit", sales - expenses)
    status = F.lit(stated["Profit Status"]) if stated.get("Profit Status") else F.when(
        profit.double() >= 0, "Profit").otherwise("Loss")
    return base.select(
        sales.shown().alias("total_sales"), expenses.shown().alias("total_expenses"),
        credit.shown().alias("credit_outstanding"), profit.shown().alias("net_profit"),
        status.alias("profit_status"), "transaction_count", "sales_transaction_count",
        "expense_transaction_count", "credit_transaction_count",
    )


def ledger_sales_rows(df: DataFrame, columns: LedgerColumns) -> DataFrame:
    return category_rows(df, columns, LEDGER_SALES)


def ledger_revenue(df: DataFrame, columns: LedgerColumns, grain: str = "month") -> DataFrame:
    """Sales per period; rows without a usable date are left out."""
    sales = category_rows(df, columns, LEDGER_SALES)
    return (
        sales.select(bucket(timestamp(sales, columns.date), grain).alias("_start"), "amount_value", "amount_value_rest")
        .where(F.col("_start").isNotNull())
        .groupBy("_start").agg(*Amount.of("amount_value").sum().named("_value")).orderBy("_start")
        .select(period_text(F.col("_start"), grain).alias("period"), Amount.of("_value").shown().alias("sales_revenue"))
    )


def ledger_change(df: DataFrame, columns: LedgerColumns, grain: str = "month") -> DataFrame:
    """Sales of the first and last period and the change between them (0 when the first is 0)."""
    ends = ledger_revenue(df, columns, grain).agg(
        F.count(F.lit(1)).alias("periods"), F.min_by("sales_revenue", "period").alias("first_value"),
        F.max_by("sales_revenue", "period").alias("last_value"))
    change = F.coalesce(F.try_divide(F.col("last_value") - F.col("first_value"), F.col("first_value")) * 100, F.lit(0.0))
    return ends.where(F.col("periods") >= 2).select("*", half_up(change, 1).alias("change_pct"))


def ledger_items(
    df: DataFrame, columns: LedgerColumns, category: str, label_name: str, value_name: str, limit: int | None = None,
) -> DataFrame:
    """Totals per item (or customer) of one transaction type, largest first."""
    grouped = (
        category_rows(df, columns, category).where(col(columns.item).isNotNull())
        .groupBy(col(columns.item).cast("string").alias(label_name)).agg(*Amount.of("amount_value").sum().named("_value"))
        .orderBy(*Amount.of("_value").largest_first(), F.asc(label_name))
    )
    shown = grouped if limit is None else grouped.limit(limit)
    return shown.select(label_name, Amount.of("_value").shown().alias(value_name))


def type_totals(df: DataFrame, columns: LedgerColumns) -> DataFrame:
    return (
        df.where(col(columns.kind).isNotNull())
        .groupBy(upper_trim(col(columns.kind)).alias("transaction_type"))
        .agg(*amount(df, columns.amount).sum().or_zero().named("_value"))
        .orderBy(*Amount.of("_value").largest_first(), F.asc("transaction_type"))
        .select("transaction_type", Amount.of("_value").shown().alias("amount"))
    )


def ledger_profit(df: DataFrame, columns: LedgerColumns, report_summary: DataFrame | None = None) -> DataFrame:
    return ledger_summary(df, columns, report_summary).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(column).alias("amount"))
        for name, column in (("sales", "total_sales"), ("expenses", "total_expenses"), ("net_profit", "net_profit"))
    ])))


def item_roles(df: DataFrame, columns: LedgerColumns) -> DataFrame:
    """What the item column means for each transaction type that occurs."""
    kind = F.col("transaction_type")
    # The meaning per type word.
    role = F.when(kind == LEDGER_SALES, "product_or_item").when(kind == LEDGER_CREDIT, "customer").when(
        kind == LEDGER_EXPENSE, "expense_description").otherwise("transaction_description")
    seen = df.where(col(columns.kind).isNotNull()).select(upper_trim(col(columns.kind)).alias("transaction_type"))
    return seen.distinct().withColumn("item_role", role)


def type_performance(df: DataFrame, columns: LedgerColumns, limit: int = 10) -> dict[str, DataFrame]:
    """Totals per transaction type next to the best selling items."""
    return {
        "type_totals": type_totals(df, columns).limit(limit),
        "sales_items": ledger_items(df, columns, LEDGER_SALES, columns.item, "sales_revenue", limit),
    }


def parse_money(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Amounts written with currency marks and thousands commas, as numbers."""
    return df.select(*map(col, keep), currency_amount(col(column)).shown().alias("amount_value"))
