"""Business leads: distributions, website coverage, lead scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.coerce import col, is_blank
from prismtab.operators.metrics import count_by_dimension

# Text that puts a size or revenue range into a tier, the highest tier first.
RANGE_TIERS = [
    (4, ("100m", "201-500", "500", "enterprise")),
    (3, ("50m", "51-200", "200")),
    (2, ("10m", "11-50", "50")),
]


def range_score(value: Column) -> Column:
    """4 to 2 by the first tier with a matching text, 1 for other text, 0 for null or blank."""
    text = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    score = None
    for points, parts in RANGE_TIERS:
        hit = F.contains(text, F.lit(parts[0]))
        for part in parts[1:]:
            hit = hit | F.contains(text, F.lit(part))
        score = F.when(hit, points) if score is None else score.when(hit, points)
    return score.when(F.trim(text) != "", 1).otherwise(0)


def lead_scores(
    df: DataFrame, name: str, country: str | None, industry: str | None,
    employees: str | None, revenue: str | None, limit: int = 10,
) -> DataFrame:
    """The best leads: employee tier plus twice the revenue tier; ties by name."""
    def tier(column: str | None) -> Column:
        return range_score(col(column)) if column else F.lit(0)

    def text(column: str | None) -> Column:
        return F.coalesce(col(column).cast("string"), F.lit("")) if column else F.lit("")

    return df.select(
        F.coalesce(col(name).cast("string"), F.lit("Unknown")).alias("business_name"),
        text(country).alias("country"), text(industry).alias("industry"),
        (tier(employees) + 2 * tier(revenue)).cast("bigint").alias("lead_score"),
    ).orderBy(F.desc("lead_score"), F.asc("business_name"), F.asc("country"), F.asc("industry")).limit(limit)


def distribution(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    return count_by_dimension(df, column, "value", "businesses", limit)


def no_website(df: DataFrame, website: str) -> DataFrame:
    """Businesses without a website: null or blank, each counted once."""
    return df.agg(F.count_if(is_blank(df, website)).alias("businesses")).select(
        F.lit("missing_websites").alias("metric"), "businesses")


def overview(df: DataFrame, website: str | None) -> DataFrame:
    missing = F.count_if(is_blank(df, website)) if website else F.lit(0).cast("bigint")
    counts = df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing"))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.cast("bigint").alias("value")) for name, value in (
            ("Business records", F.col("rows")), ("Columns", F.lit(len(df.columns))),
            ("Missing websites", F.col("missing")))
    ])))


def top_industry(df: DataFrame, industry: str) -> DataFrame:
    return count_by_dimension(df, industry, "industry", "businesses", 1)


def outreach(
    df: DataFrame, name: str, country: str | None, industry: str | None,
    employees: str | None, revenue: str | None, website: str | None, limit: int = 10,
) -> dict[str, DataFrame]:
    """The tables behind outreach advice: best leads, website gap, strongest industry."""
    tables = {"leads": lead_scores(df, name, country, industry, employees, revenue, limit)}
    if website:
        tables["no_website"] = no_website(df, website)
    if industry:
        tables["top_industry"] = top_industry(df, industry)
    return tables
