"""Named queries over the given tables: every operator applied to a base view."""
from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.functions import rounding
from prismtab.functions.vocabulary import (
    CREDIT_VALUES, EXPENSE_VALUES, LEDGER_CREDIT, LEDGER_EXPENSE, LEDGER_SALES, REFUND_VALUES, SALE_VALUES,
)
from prismtab.operators import (
    catalog, comparison, customers, evaluation, filters, finance, importance, leads, ledger, metrics, modeling,
    outliers, profile, quality, ranking, relations, roles, targets, trends,
)
from prismtab.operators.ledger import LedgerColumns
from prismtab.operators.metrics import Metric
from prismtab.plans import views
from prismtab.sources import delimited, records, reports, store

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

REVENUE, QUANTITY = Metric("revenue"), Metric("quantity")
COST, PROFIT = Metric("cost"), Metric("profit")
KPI_METRICS = {"revenue": REVENUE, "quantity": QUANTITY, "cost": COST}
SIGNED = Metric("amount", type_column="category", include=SALE_VALUES, subtract=REFUND_VALUES)
EXPENSE = Metric("amount", type_column="category", include=EXPENSE_VALUES)
CREDIT = Metric("amount", type_column="category", include=CREDIT_VALUES)
LEDGER = LedgerColumns("date", "category", "item", "amount")
LINE_NUMBERS = ["quantity", "gross_sales", "discount", "tax"]


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function
    return register


def on(view: Callable[[SparkSession, str], DataFrame], name: str, operator: Callable, *args, **kwargs) -> None:
    """Register ``operator(view, *args, **kwargs)``."""
    QUERIES[name] = lambda spark, sf_dir: operator(view(spark, sf_dir), *args, **kwargs)


def sales(*dimensions: str, measures: tuple[str, ...] = ("revenue",)):
    return partial(views.sales_totals, dimensions=list(dimensions), measures=measures)


# --- business metrics --------------------------------------------------------------------------

ALL_SALES = sales(measures=("revenue", "quantity", "cost"))

on(ALL_SALES, "business_kpis", metrics.business_kpis, KPI_METRICS, rows="rows")
on(ALL_SALES, "kpi_cards", metrics.kpi_cards, KPI_METRICS, rows="rows")
on(ALL_SALES, "profit_summary", metrics.profit_summary, KPI_METRICS, rows="rows")
on(ALL_SALES, "business_overview", metrics.business_overview, KPI_METRICS, rows="rows")
on(views.ledger, "average_order_value", metrics.average_order_value, SIGNED)
on(views.ledger, "revenue_signed", metrics.business_kpis, {"revenue": SIGNED, "expense": EXPENSE})
on(views.invoice_lines, "revenue_derived", metrics.business_kpis,
   {"revenue": Metric("quantity", times="unit_price"), "quantity": QUANTITY}, rows="rows")

on(sales("order_date"), "revenue_by_date", metrics.metric_by_period, "order_date", REVENUE, "day", "date")
on(sales("order_date"), "revenue_by_month", metrics.metric_by_period, "order_date", REVENUE, "month")
on(sales("product"), "top_products", metrics.metric_by_dimension, "product", REVENUE)
on(sales("category"), "top_categories", metrics.metric_by_dimension, "category", REVENUE)
on(sales("customer"), "top_customers", metrics.metric_by_dimension, "customer", REVENUE)
on(sales("region"), "top_regions", metrics.metric_by_dimension, "region", REVENUE)
on(sales("product", measures=("quantity",)), "top_products_by_quantity",
   metrics.metric_by_dimension, "product", QUANTITY, value_name="quantity")
on(sales("category"), "top_categories_by_transactions", metrics.count_by_dimension, "category", "category", rows="rows")
on(sales("product"), "rank_product_revenue", metrics.metric_by_dimension, "product", REVENUE, "product", "revenue", 10)
on(sales("product", measures=("profit",)), "rank_product_profit",
   metrics.metric_by_dimension, "product", PROFIT, "product", "profit", 10)
on(sales("country"), "rank_region_revenue", metrics.metric_by_dimension, "country", REVENUE, "region", "revenue", 10)
on(views.ledger, "expense_by_type", metrics.expense_by_group, EXPENSE, "category")
on(views.ledger, "expense_total", metrics.expense_by_group, EXPENSE, None)
on(sales("product", "order_date"), "top_product_monthly", metrics.top_product_monthly, "order_date", "product", REVENUE)
on(sales("product", "order_date"), "product_growth", metrics.product_growth, "order_date", "product", REVENUE)
on(partial(views.star_sums, metrics={"category": metrics.TOP_CATEGORY, "region": metrics.TOP_REGION}),
   "total_sales_overview", metrics.leading_values, REVENUE)
on(sales("category"), "revenue_share", metrics.revenue_share, "category", REVENUE, "category")


@query("growing_products_growth")
def _growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.growing_products(QUERIES["product_growth"](spark, sf_dir))


@query("declining_products_growth")
def _declining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.declining_products(QUERIES["product_growth"](spark, sf_dir))


@query("growth_table")
def _growth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.growth_table(QUERIES["product_growth"](spark, sf_dir))


@query("analysis_summary")
def _analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpis = metrics.business_kpis(ALL_SALES(spark, sf_dir), KPI_METRICS, rows="rows")
    return quality.analysis_summary(views.repeated(spark, sf_dir), kpis)


# --- profile and quality -----------------------------------------------------------------------


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.coerce_by_roles(views.dirty(spark, sf_dir))


@query("column_profile")
def _column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coerced(spark, sf_dir)
    stats = profile.column_stats(df)
    return profile.column_profile(df, roles.shown_roles(stats), stats)


def with_stats(view: Callable, name: str, operator: Callable, *args) -> None:
    """Register an operator that needs the shared statistics of its view."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = view(spark, sf_dir)
        return operator(df, profile.column_stats(df), *args)
    QUERIES[name] = run


on(coerced, "numeric_summary", profile.numeric_summary)
on(views.readings, "skewness", profile.skewness, ["value", "user_id"])
with_stats(coerced, "cardinality", profile.cardinality)
on(views.dirty, "categorical_top_values", profile.categorical_top_values, ["status", "priority", "channel"])
with_stats(coerced, "suspicious_columns", profile.suspicious_columns)
with_stats(coerced, "profile_quality_score", quality.profile_quality_score)
with_stats(views.dirty, "data_quality", quality.data_quality)
on(views.repeated, "duplicate_rows", quality.duplicate_rows)
on(views.repeated, "duplicate_rows_fingerprint", quality.duplicate_rows, fingerprint=True)
on(views.dirty, "missing_values", quality.missing_values)
on(views.dirty, "missing_report", quality.missing_report)
on(views.dirty, "completeness", quality.completeness)
on(views.dirty, "quality_assessment", quality.quality_assessment)
on(views.order_lines, "describe_numeric", quality.describe_numeric, LINE_NUMBERS)
on(views.dirty, "categorical_summary", quality.categorical_summary, ["status", "priority", "channel", "order_date"])
with_stats(views.dirty, "column_kinds", quality.column_kinds)
on(views.dirty, "unique_values", profile.unique_values)
with_stats(coerced, "dataset_warnings", quality.dataset_warnings)
on(views.dirty, "schema_profile", profile.schema_profile)
on(views.finance, "preview", filters.preview, "entry_id")
on(views.ledger, "money_parse", ledger.parse_money, "amount", "entry_id", "line_no")


@query("coerced_types")
def _coerced_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = filters.coerce_columns(views.dirty(spark, sf_dir), ["amount"], ["order_date"])
    return df.withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


@query("dataset_overview")
def _dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.finance(spark, sf_dir)
    kind, _ = roles.profile_table_type(profile.column_stats(df, distinct=False))
    return quality.dataset_overview(df, kind)


# --- correlations, outliers, histograms --------------------------------------------------------

on(views.order_lines, "correlation_pairs", relations.correlation_pairs, LINE_NUMBERS)
on(views.order_lines, "correlation_matrix", relations.correlation_matrix, LINE_NUMBERS)
on(views.order_lines, "correlation_top", relations.correlation_top, LINE_NUMBERS)
on(views.order_lines, "correlation_strength", relations.correlation_strength, LINE_NUMBERS)


def line_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a net amount and tax amount, which follow the gross amount closely."""
    lines = views.order_lines(spark, sf_dir)
    return lines.select(
        "quantity", "gross_sales", (F.col("gross_sales") * (1 - F.col("discount"))).alias("net_sales"),
        (F.col("gross_sales") * F.col("tax")).alias("tax_amount"))


on(line_amounts, "strong_correlations", relations.strong_correlations)
on(line_amounts, "driver_columns", relations.driver_columns)
on(views.readings, "outliers_iqr", outliers.outliers_iqr, ["value", "user_id"])
on(views.readings, "outliers_any_size", outliers.outliers_any_size, ["value", "user_id"])
on(views.readings, "outliers_pct", outliers.outliers_pct, ["value", "user_id"])
on(views.readings, "outlier_samples", outliers.outlier_samples, "value", ["event_id"])
on(views.readings, "capped_outliers", outliers.cap_outliers, ["value"])
on(views.order_lines, "histogram_int", outliers.histogram, "quantity")
on(views.catalog, "histogram_calories", outliers.histogram, "calories")
on(views.readings, "histogram_float", outliers.histogram, "value")
on(views.finance, "histogram_summary", outliers.histogram_summary, "income")

# --- trends ------------------------------------------------------------------------------------


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.trend_series(views.readings(spark, sf_dir), "ts", ["value", "user_id"])


def monthly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.trend_series(views.order_lines(spark, sf_dir), "ship_date", LINE_NUMBERS)


def weekly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select(
        "o_orderdate", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))
    return trends.trend_series(orders, "o_orderdate", ["o_totalprice"], grain="week")


on(daily, "trend_series", trends.trend_points)
on(weekly_totals, "trend_series_weekly", trends.trend_points)
on(monthly_lines, "trend_series_monthly", trends.trend_points)
on(monthly_lines, "trend_slope", trends.trend_slope)
on(monthly_lines, "trend_change", trends.trend_change)
on(monthly_lines, "trend_anomalies", trends.trend_anomalies)
on(weekly_totals, "trend_tail", trends.trend_tail)
on(sales("order_date"), "trend_gapfilled_monthly", trends.trend_gapfilled, "order_date", "revenue", "month")
on(sales("order_date"), "trend_gapfilled_weekly", trends.trend_gapfilled, "order_date", "revenue", "week")
on(sales("order_date"), "trend_gapfilled_quarterly", trends.trend_gapfilled, "order_date", "revenue", "quarter")
on(sales("order_date"), "trend_growth", trends.first_to_last, "order_date", "revenue", "month")


@query("single_period_warning")
def _single_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.single_period_warning(QUERIES["revenue_by_month"](spark, sf_dir))


# --- rankings ----------------------------------------------------------------------------------

on(sales("product"), "tools_top_products", ranking.rank_groups, "product", "revenue")
on(sales("product"), "bottom_products", ranking.rank_groups, "product", "revenue", ascending=True)
on(sales("product", "order_date"), "trending_products", ranking.trending, "product", "revenue", "order_date")
on(sales("order_date"), "revenue_trend_weekly", ranking.revenue_trend, "order_date", "revenue", "week")
on(sales("order_date"), "revenue_trend_yearly", ranking.revenue_trend, "order_date", "revenue", "year")
on(sales("region"), "dimension_performance", ranking.rank_groups, "region", "revenue")
on(sales("brand"), "rank_groups", ranking.rank_groups, "brand", "revenue", 5, ascending=True)
on(views.order_lines, "compare_groups", ranking.compare_groups, "return_flag", ["quantity", "gross_sales"])
on(sales("category"), "insight_best_worst", ranking.best_and_worst, "category", "revenue")
on(sales("order_date"), "insight_recent_growth", ranking.recent_growth, "order_date", "revenue")
on(views.dirty, "insight_missing_pct", quality.missing_share, 5.0)
on(sales("region"), "insight_concentration", ranking.concentration, "region", "revenue", 3, 50.0)
on(views.catalog, "filter_contains", filters.filter_rows, "food_name", "RING")
on(views.catalog, "filter_regex", filters.filter_rows, "food_name", "(small|large) r", literal=False)
on(views.catalog, "filter_number", filters.filter_counts, "calories", "24")
on(views.catalog, "filter_shown", filters.filter_shown, "food_name", "widget", "entry_no")
on(views.catalog, "filter_value_counts", filters.filter_value_counts, "category")

# --- ledger, leads, customers, finance, catalog ------------------------------------------------

on(views.ledger, "ledger_summary", ledger.ledger_summary, LEDGER)
on(views.ledger, "ledger_revenue_by_month", ledger.ledger_revenue, LEDGER, "month")
on(views.ledger, "ledger_change", ledger.ledger_change, LEDGER, "month")
on(views.ledger, "ledger_sales_items", ledger.ledger_items, LEDGER, LEDGER_SALES, "item", "sales_revenue", 10)
on(views.ledger, "ledger_expenses", ledger.ledger_items, LEDGER, LEDGER_EXPENSE, "item", "total_expense")
on(views.ledger, "ledger_credit", ledger.ledger_items, LEDGER, LEDGER_CREDIT, "customer", "credit_outstanding", 10)
on(views.ledger, "ledger_type_totals", ledger.type_totals, LEDGER)
on(views.ledger, "ledger_profit", ledger.ledger_profit, LEDGER)
on(views.ledger, "ledger_item_roles", ledger.item_roles, LEDGER)
on(views.ledger, "is_ledger", roles.ledger_check)


@query("ledger_sales_rows")
def _ledger_sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.ledger_sales_rows(views.ledger(spark, sf_dir), LEDGER)
    return rows.select("entry_id", "line_no", "item", F.col("amount_value").cast("double").alias("amount_value"))


LEAD_COLUMNS = ("business_name", "country", "industry", "employee_range", "revenue_range")
on(views.leads, "lead_score", leads.lead_scores, *LEAD_COLUMNS)
on(views.leads, "leads_by_country", leads.distribution, "country")
on(views.leads, "leads_by_industry", leads.distribution, "industry")
on(views.leads, "leads_by_employee_range", leads.distribution, "employee_range")
on(views.leads, "leads_by_revenue_range", leads.distribution, "revenue_range")
on(views.leads, "leads_no_website", leads.no_website, "website")
on(views.leads, "leads_overview", leads.overview, "website")
on(views.leads, "leads_top_industry", leads.top_industry, "industry")

on(views.customers, "top_customers_share", customers.top_customers, "customer", "spend")
on(views.customers, "customer_segments", customers.distribution, "segment")
on(views.customers, "customer_locations", customers.distribution, "country")
on(views.finance, "finance_expense", finance.expense_summary, "expense", "account")
on(views.finance, "finance_income_expense", finance.income_expense, "income", "expense")
on(views.finance, "finance_monthly", finance.monthly_trend, "transaction_date", "income")
on(views.catalog, "catalog_frequency", catalog.catalog_frequency)
on(views.catalog, "catalog_stats", catalog.catalog_stats, ["calories", "price"])

# --- column meaning ----------------------------------------------------------------------------

on(views.dirty, "column_roles", roles.column_roles)
on(views.order_lines, "semantic_roles", roles.semantic_roles)
on(views.finance, "dataset_type", roles.dataset_type)
on(views.leads, "dataset_type_scores", roles.dataset_type_scores)
with_stats(views.dirty, "identifier_like", targets.identifier_like)
with_stats(views.order_lines, "target_suggestions", targets.suggest_targets)


def shape_tests(df: DataFrame) -> DataFrame:
    """Which columns read as dates, numbers or ranges."""
    rows = [(s.name, s.date_like, s.numeric_like, s.range_like) for s in profile.column_stats(df, distinct=False)]
    return profile.local_frame(df.sparkSession, rows,
                               "column_name string, date_like boolean, numeric_like boolean, range_like boolean")


on(views.leads, "range_like", lambda df: shape_tests(df).select("column_name", "range_like"))
on(views.dirty, "date_like", lambda df: shape_tests(df).select("column_name", "date_like"))
on(views.dirty, "numeric_like", lambda df: shape_tests(df).select("column_name", "numeric_like"))


@query("safe_features")
def _safe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.dirty(spark, sf_dir)
    return targets.safe_features(df, "total")


# --- sources -----------------------------------------------------------------------------------

on(views.ragged_lines, "csv_repair", delimited.repair_lines, ["entry_no", "name", "brand", "size"])
@query("csv_multiline")
def _csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = records.whole_records(views.multiline_lines(spark, sf_dir), ",")
    return delimited.repair_lines(whole.select(F.col("value").cast("string").alias("value")), ["entry_no", "name", "brand"])


on(views.part_text, "numeric_promotion", delimited.promote_numeric)
on(views.report_lines, "report_summary", reports.report_facts)
on(views.dataset_registry, "recent_datasets", store.recent_datasets)
on(views.dataset_registry, "recent_datasets_of_user", store.recent_datasets, 7)


@query("report_detail")
def _report_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.detail_table(reports.report_rows(views.report_lines(spark, sf_dir)), views.REPORT_HEADER)
    return rows.select("source", "line_no", F.col("Date").alias("date"), F.col("Category").alias("category"),
                       F.col("Item/Customer").alias("item"), F.col("Amount").alias("amount"))


@query("json_safe")
def _json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ratios(spark, sf_dir).select("order_id", "line_no", rounding.json_safe(F.col("ratio")).alias("ratio"))


@query("report_cells")
def _report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.col("cell")
    return views.ratios(spark, sf_dir).select("order_id", "line_no", delimited.cell_text(cell).alias("text"), delimited.cell_number(cell).alias("number"))


on(views.large_amounts, "large_amounts_by_store", metrics.metric_by_dimension, "store", Metric("amount"))
on(views.large_amounts, "large_amounts_ranked", ranking.rank_groups, "l_returnflag", "amount")
on(views.dirty, "coerced_by_roles", roles.coerce_by_roles)
on(views.leads, "semantic_columns", roles.semantic_table)
on(views.order_lines, "metric_specs", roles.metric_table)
on(views.order_lines, "detected_columns", roles.detected_table)
on(views.order_lines, "feasible_tasks", roles.task_table)
on(views.order_lines, "chosen_target", targets.chosen_target)
on(views.customers, "customer_recommendations", customers.recommendation_table, "customer", "spend", "segment")

WRITTEN_DATES = ["day_first", "month_first", "alike", "short"]
on(views.written_dates, "date_orders", profile.date_orders)
on(views.written_dates, "written_dates", filters.coerce_columns, dates=WRITTEN_DATES)


# --- free-form tools ---------------------------------------------------------------------------

on(views.finance, "time_series_mean", comparison.time_series, "transaction_date", "income", "month", "mean")
on(views.finance, "time_series_count", comparison.time_series, "transaction_date", "income", "week", "count")
on(views.order_lines, "group_aggregation", comparison.group_aggregation, ["return_flag", "line_status"], "gross_sales",
   ["sum", "mean", "count", "min", "max"])
on(views.order_lines, "scatter_correlation", comparison.scatter_correlation, "quantity", "gross_sales", "return_flag")
on(views.order_lines, "scatter_points", comparison.scatter_points, "quantity", "gross_sales", "return_flag")
on(views.order_lines, "metric_ratio", comparison.ratio_metric, "gross_sales", "quantity", ["return_flag"])
on(sales("order_date"), "metric_growth", comparison.growth_metric, "order_date", "revenue", "month")
on(lambda spark, sf_dir: views.customers(spark, sf_dir).withColumn("spend", F.col("spend").cast("double")), "metric_tiers",
   comparison.tier, "spend", {"Gold": 3000000, "Silver": 1500000, "Bronze": 0})
on(views.order_lines, "metric_median", comparison.single_metric, "gross_sales", "median")
on(views.order_lines, "metric_sum", comparison.single_metric, "gross_sales", "sum")
on(views.order_lines, "segments_welch", comparison.welch, "return_flag", ("A", "R"), ["quantity", "gross_sales"])
on(views.order_lines, "segments_ranks", comparison.mann_whitney, "return_flag", ("A", "R"), "gross_sales")
on(views.order_lines, "compare_segments", comparison.compare_segments, "return_flag", ("A", "R"), ["quantity", "gross_sales"])


# --- models ------------------------------------------------------------------------------------

on(views.line_predictions, "regression_metrics", evaluation.regression_metrics)
on(views.predictions, "classification_metrics", evaluation.classification_metrics)
on(views.predictions, "confusion_matrix", evaluation.confusion_matrix)
on(views.predictions, "class_balance", evaluation.class_balance, "predicted")
on(views.catalog, "leakage_determinism", evaluation.leakage_determinism, ["food_name", "entry_no", "cuisine"], "category")

LINE_KEYS = ["order_id", "line_no"]


@query("ml_regression")
def _ml_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.retail(spark, sf_dir).drop("profit", "stockout_flag")
    return modeling.score_table(df, modeling.train_model(df, "total_sales", "regression"))


@query("ml_classification")
def _ml_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.retail(spark, sf_dir)
    return modeling.score_table(df, modeling.train_model(df, "stockout_flag", "classification"))


@query("feature_importance")
def _feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.retail(spark, sf_dir).drop("profit", "stockout_flag")
    return modeling.feature_importance(df, modeling.train_model(df, "total_sales", "regression"))


@query("permutation_importance")
def _permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.retail(spark, sf_dir).drop("profit", "stockout_flag")
    trained = modeling.train_model(df, "total_sales", "regression", LINE_KEYS)
    return importance.permutation_importance(trained, LINE_KEYS)


on(views.retail, "linear_targets", modeling.linear_targets, ["total_sales", "profit"], ["quantity", "unit_price"])
on(views.retail, "metric_targets", targets.metric_targets, {
    "how will profit change": "profit", "units next month": "quantity", "which category is this": None, "sales next month": "revenue", "what next": "orders"})


@query("ml_batch_targets")
def _ml_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.retail(spark, sf_dir)
    tasks = {"total_sales": "regression", "profit": "regression", "stockout_flag": "classification"}
    return modeling.batch_table(df, modeling.batch_train(df, tasks))


on(views.retail, "local_contributions", modeling.local_contributions, "total_sales",
   ["quantity", "discount", "tax", "unit_price", "category"], LINE_KEYS, 3)
on(views.order_lines, "segments", modeling.segments, LINE_NUMBERS)
on(views.order_lines, "ml_quick_predict", modeling.quick_predict, "gross_sales", ["quantity", "discount", "tax"])
on(views.readings, "ml_quick_classes", modeling.quick_predict, "event_type", ["user_id", "value"])
