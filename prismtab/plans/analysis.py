"""The full analysis of one table: meaning of the columns first, then every table that applies.

One statistics pass decides the roles; each result is a DataFrame that is computed when read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from prismtab.functions.coerce import numeric_columns
from prismtab.functions.vocabulary import LEDGER_CREDIT, LEDGER_EXPENSE, LEDGER_SALES
from prismtab.operators import (
    catalog, customers, finance, leads, ledger, metrics, modeling, outliers, profile, quality, ranking,
    relations, roles, targets, trends,
)
from prismtab.operators.profile import ColumnStats


@dataclass
class Analysis:
    table_type: str
    metric_type: str
    roles: dict[str, str]
    tables: dict[str, DataFrame]
    limitations: list[str]
    model: modeling.Training | None = None


def analyze(
    df: DataFrame, filename: str = "", target: str | None = None, train: bool = False,
    report_facts: DataFrame | None = None,
) -> Analysis:
    """Every table that the columns of `df` allow. Models are fitted only when asked for."""
    coerced = roles.coerce_by_roles(df)
    stats = profile.column_stats(coerced)
    # Ledger words and id shapes are read from the table as it came.
    raw = profile.column_stats(df) if coerced.schema != df.schema else stats
    metric_roles = roles.metric_roles(raw)
    found = roles.metric_map(metric_roles)
    kind, _ = roles.profile_table_type(raw, filename, has_summary=report_facts is not None)
    metric_kind, _ = roles.metric_table_type(raw, metric_roles, filename)
    tables, limitations = _business_tables(df, found)
    tables |= _profile_tables(coerced, stats)
    tables |= _trend_tables(coerced, stats)
    tables |= _domain_tables(df, kind, metric_kind, raw, report_facts)
    model = None
    if train or target:
        model = modeling.train_model(coerced, target, stats=stats)
        limitations += model.limitations
        if model.status == "complete":
            tables["model_scores"] = modeling.score_table(coerced, model)
            tables["feature_importance"] = modeling.feature_importance(coerced, model)
    return Analysis(kind, metric_kind, metric_roles, tables, limitations, model)


def _business_tables(df: DataFrame, found: roles.MetricMap) -> tuple[dict[str, DataFrame], list[str]]:
    given = found.metrics
    missing = {
        "no_date: nothing can be laid out over time": found.date,
        "no_product: products cannot be ranked": found.product,
        "no_category: categories cannot be ranked": found.category,
        "no_revenue: no column or pair of columns stands for revenue": given.get("revenue"),
    }
    limitations = [text for text, needed in missing.items() if not needed]
    tables = {"kpis": metrics.business_kpis(df, given), "kpi_cards": metrics.kpi_cards(df, given),
              "profit_summary": metrics.profit_summary(df, given)}
    revenue = given.get("revenue")
    if revenue:
        if found.date:
            tables["revenue_by_date"] = metrics.metric_by_period(df, found.date, revenue, "day", "date")
            tables["revenue_by_month"] = metrics.metric_by_period(df, found.date, revenue, "month")
        for name in ("product", "category", "customer", "region", "store"):
            column = getattr(found, name)
            if column:
                tables[f"revenue_by_{name}"] = metrics.metric_by_dimension(df, column, revenue, name)
        if found.date and found.product:
            tables["product_monthly"] = metrics.top_product_monthly(df, found.date, found.product, revenue)
            tables["product_growth"] = metrics.product_growth(df, found.date, found.product, revenue)
        if found.category and found.region:
            tables["total_sales"] = metrics.total_sales_overview(df, found.category, found.region, revenue)
        share = found.category or found.product
        if share:
            tables["revenue_share"] = metrics.revenue_share(
                df, share, revenue, "category" if found.category else "product")
    if found.product:
        for name in ("quantity", "profit"):
            if name in given:
                tables[f"{name}_by_product"] = metrics.metric_by_dimension(df, found.product, given[name], "product", name, 10)
    if found.category:
        tables["transactions_by_category"] = metrics.count_by_dimension(df, found.category, "category")
    if "expense" in given:
        tables["expenses"] = metrics.expense_by_group(df, given["expense"], found.transaction_type or found.category)
    return tables, limitations


def _profile_tables(df: DataFrame, stats: list[ColumnStats]) -> dict[str, DataFrame]:
    labels = [s.name for s in stats if quality.kind_of(s) in ("categorical", "text")]
    tables = {
        "column_profile": profile.column_profile(df, roles.shown_roles(stats), stats),
        "cardinality": profile.cardinality(df, stats),
        "suspicious_columns": profile.suspicious_columns(df, stats),
        "missing_values": quality.missing_values(df),
        "data_quality": quality.data_quality(df, stats),
        "profile_score": quality.profile_quality_score(df, stats),
        "warnings": quality.dataset_warnings(df, stats),
        "target_suggestions": targets.suggest_targets(df, stats),
    }
    if labels:
        tables["top_values"] = profile.categorical_top_values(df, labels)
    numbers = numeric_columns(df)
    if numbers:
        tables |= {
            "describe": quality.describe_numeric(df), "skewness": profile.skewness(df),
            "outliers": outliers.outliers_iqr(df), "correlations": relations.correlation_pairs(df),
            "strong_correlations": relations.strong_correlations(df)}
        tables |= {f"histogram_{n}": outliers.histogram(df, n) for n in numbers}
    return tables


def _trend_tables(df: DataFrame, stats: list[ColumnStats]) -> dict[str, DataFrame]:
    dates = [s.name for s in stats if s.date_like_for_trends]
    if not dates or not numeric_columns(df):
        return {}
    makers = {"trend_tail": trends.trend_tail, "trend_slope": trends.trend_slope,
              "trend_change": trends.trend_change, "trend_anomalies": trends.trend_anomalies}
    tables = {}
    for date in dates:  # tables of the first date column have plain names
        series = trends.trend_series(df, date)
        tables |= {name if date == dates[0] else f"{name}_{date}": make(series) for name, make in makers.items()}
    return tables


def _domain_tables(
    df: DataFrame, kind: str, metric_kind: str, stats: list[ColumnStats], report_facts: DataFrame | None,
) -> dict[str, DataFrame]:
    """The ready-made tools of the kind of table."""
    semantic = roles.semantic_columns(stats)
    if kind in roles.LEDGER_TYPES:
        return _ledger_tables(df, report_facts)
    if kind == "business_leads":
        return _lead_tables(df, semantic)
    if kind == "customer":
        return _customer_tables(df, semantic)
    if kind == "finance":
        return _finance_tables(df, semantic)
    if "food_dataset" in (kind, metric_kind):
        return _catalog_tables(df)
    return _sales_tables(df, semantic) if kind == "sales" else {}


def _ledger_tables(df: DataFrame, report_facts: DataFrame | None) -> dict[str, DataFrame]:
    columns = roles.ledger_columns(df.columns)
    stated = None if report_facts is None else report_facts.where("section = 'summary'")
    return {
        "ledger_summary": ledger.ledger_summary(df, columns, stated), "ledger_revenue": ledger.ledger_revenue(df, columns),
        "ledger_change": ledger.ledger_change(df, columns), "ledger_types": ledger.type_totals(df, columns),
        "ledger_profit": ledger.ledger_profit(df, columns, stated), "ledger_roles": ledger.item_roles(df, columns),
        "ledger_sales": ledger.ledger_items(df, columns, LEDGER_SALES, columns.item, "sales_revenue", 10),
        "ledger_expenses": ledger.ledger_items(df, columns, LEDGER_EXPENSE, columns.item, "total_expense", 10),
        "ledger_credit": ledger.ledger_items(df, columns, LEDGER_CREDIT, columns.item, "credit_outstanding", 10),
    }


def _lead_tables(df: DataFrame, semantic: dict[str, str | None]) -> dict[str, DataFrame]:
    tables = {"leads_overview": leads.overview(df, semantic["website"])}
    if semantic["business_name"]:
        tables |= leads.outreach(df, semantic["business_name"], semantic["country"], semantic["industry"],
                                 semantic["employee_range"], semantic["revenue_range"], semantic["website"])
    for role in ("country", "industry", "employee_range", "revenue_range"):
        if semantic[role]:
            tables[f"leads_by_{role}"] = leads.distribution(df, semantic[role])
    return tables


def _customer_tables(df: DataFrame, semantic: dict[str, str | None]) -> dict[str, DataFrame]:
    customer = roles.find_column(df, ["customer", "customer_name", "client", "buyer"], semantic)
    spend = roles.find_column(df, ["spend", "total_spend", "lifetime_value", "ltv", "revenue", "amount"], semantic)
    segment = roles.find_column(df, ["segment", "country", "city"], semantic)
    place = roles.find_column(df, ["country", "city", "region", "state"], semantic)
    tables = customers.recommendations(df, customer, spend, segment) if customer and spend else {}
    return tables | ({"customer_locations": customers.distribution(df, place)} if place else {})


def _finance_tables(df: DataFrame, semantic: dict[str, str | None]) -> dict[str, DataFrame]:
    expense = roles.find_column(df, ["expense", "expenses", "cost", "debit", "amount"], semantic)
    income = roles.find_column(df, ["income", "revenue", "credit"], semantic)
    category = roles.find_column(df, ["category", "account", "type"], semantic)
    date = roles.find_column(df, ["transaction_date", "date", "posted_date"], semantic)
    value = roles.find_column(df, ["amount", "expense", "income", "revenue"], semantic)
    tables = {"finance_expense": finance.expense_summary(df, expense, category)} if expense else {}
    if income and expense:
        tables["finance_income_expense"] = finance.income_expense(df, income, expense)
    if date and value:
        tables["finance_monthly"] = finance.monthly_trend(df, date, value)
    return tables


def _catalog_tables(df: DataFrame) -> dict[str, DataFrame]:
    by_name = {c.lower(): c for c in df.columns}
    described = [by_name[c] for c in catalog.CATALOG_COLUMNS if c in by_name]
    tables = {"catalog_frequency": catalog.catalog_frequency(df, described)} if described else {}
    if "calories" in by_name:
        tables["catalog_stats"] = catalog.catalog_stats(df, [by_name["calories"]])
    return tables


def _sales_tables(df: DataFrame, semantic: dict[str, str | None]) -> dict[str, DataFrame]:
    product, revenue, date = semantic["product"], semantic["revenue"], semantic["date"]
    tables = {}
    if revenue and product:
        tables["top_products"] = ranking.rank_groups(df, product, revenue)
        tables["bottom_products"] = ranking.rank_groups(df, product, revenue, ascending=True)
        if date:
            tables["trending_products"] = ranking.trending(df, product, revenue, date)
    if revenue and date:
        tables["revenue_trend"] = ranking.revenue_trend(df, date, revenue)
    for role in ("category", "region", "customer"):
        if revenue and semantic[role]:
            tables[f"{role}_performance"] = ranking.rank_groups(df, semantic[role], revenue)
    return tables
