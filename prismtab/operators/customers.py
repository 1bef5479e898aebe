"""Customer spend and customer distributions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.functions.amounts import Amount, amount
from prismtab.functions.coerce import col
from prismtab.functions.rounding import percent
from prismtab.operators.metrics import count_by_dimension


def top_customers(df: DataFrame, customer: str, spend: str, limit: int = 10) -> DataFrame:
    """The biggest spenders with their share of all spend, also of rows without a customer."""
    groups = df.groupBy(col(customer).cast("string").alias("_customer")).agg(*amount(df, spend).sum().named("_value"))
    spent = Amount.of("_value")
    # Rows without a customer go last and are left out after the limit: a filter before it would reach
    # the scan, and the total could not share this grouping.
    top = groups.orderBy(F.isnull("_customer"), *spent.largest_first(), F.asc("_customer")).limit(limit).where(
        F.col("_customer").isNotNull() & spent.known())
    total = groups.agg(spent.sum().double().alias("total")).scalar()
    return top.select(F.col("_customer").alias(customer), spent.shown().alias(f"total_{spend}"),
                      percent(spent.double(), total, 1).alias("share_pct"))


def distribution(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    return count_by_dimension(df, column, "value", "customers", limit)


def recommendation_table(df: DataFrame, customer: str, spend: str, group: str | None) -> DataFrame:
    """(topic, label, value) of the tables behind customer advice, as one table."""
    parts = [frame.select(F.lit(topic).alias("topic"), F.col(frame.columns[0]).cast("string").alias("label"), F.col(frame.columns[1]).cast("double").alias("value"))
             for topic, frame in recommendations(df, customer, spend, group).items()]
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def recommendations(df: DataFrame, customer: str, spend: str, group: str | None) -> dict[str, DataFrame]:
    """The tables behind customer advice."""
    tables = {"top_customers": top_customers(df, customer, spend)}
    if group:
        tables["distribution"] = distribution(df, group)
    return tables
