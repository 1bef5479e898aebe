"""Business metrics on small frames with known results."""
import pytest

from prismtab.functions.vocabulary import EXPENSE_VALUES, REFUND_VALUES, SALE_VALUES
from prismtab.operators import metrics, ranking, roles
from prismtab.operators.metrics import Metric
from prismtab.operators.profile import column_stats


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame([
        ("2026-05-01", "SALES", "Rice", 5000.0), ("2026-05-02", " sales ", "Oil", 2000.0),
        ("2026-05-03", "EXPENSE", "Rent", 500.0), ("2026-05-04", "UDHAAR", "Ali", 500.0),
    ], "Date string, Category string, Item string, Amount double")


@pytest.fixture(scope="module")
def trend(spark):
    return spark.createDataFrame([
        ("2026-01-10", "Oil", 10, 400.0), ("2026-01-12", "Rice", 5, 300.0), ("2026-02-01", "Oil", 9, 900.0),
        ("2026-02-02", "Rice", 2, 100.0), ("bad", "Oil", 1, 7.0),
    ], "Date string, Product string, Quantity int, Sales double")


SIGNED = Metric("Amount", type_column="Category", include=SALE_VALUES, subtract=REFUND_VALUES)
EXPENSE = Metric("Amount", type_column="Category", include=EXPENSE_VALUES)


def test_signed_ledger(ledger):
    kpi = metrics.business_kpis(ledger, {"revenue": SIGNED, "expense": EXPENSE}).first()
    assert (kpi.total_revenue, kpi.total_expenses, kpi.total_profit) == (7000.0, 500.0, 6500.0)
    assert (kpi.transaction_count, kpi.sales_transaction_count, kpi.average_order_value) == (4, 2, 3500.0)
    assert rows(metrics.metric_by_period(ledger, "Date", SIGNED)) == [("2026-05", 7000.0)]


def test_refunds_are_taken_away(spark):
    df = spark.createDataFrame([("SALE", 10.0), ("return", 4.0), ("other", 99.0), (None, 5.0)], "Category string, Amount double")
    assert metrics.business_kpis(df, {"revenue": SIGNED}).first().total_revenue == 6.0


def test_bad_numbers_count_zero(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), (None,), (" 2 ",), ("1d",), ("NaN",)], "v string")
    assert metrics.business_kpis(df, {"revenue": Metric("v")}).first().total_revenue == 3.5


def test_derived_revenue(spark):
    df = spark.createDataFrame([("2", 50.0), (None, 9.0), ("2", 50.0)], "Qty string, Price double")
    assert metrics.business_kpis(df, {"revenue": Metric("Qty", times="Price")}).first().total_revenue == 200.0


def test_cost_of_zero_falls_through_to_expense(spark):
    df = spark.createDataFrame([(100.0, 0.0, 30.0)], "r double, c double, e double")
    given = {"revenue": Metric("r"), "cost": Metric("c"), "expense": Metric("e")}
    assert metrics.business_kpis(df, given).first().total_profit == 70.0


def test_no_revenue_is_invented(spark):
    df = spark.createDataFrame([("a", 1, "x")], "Name string, Score int, Notes string")
    found = roles.metric_map(roles.metric_roles(column_stats(df)))
    assert "revenue" not in found.metrics
    assert metrics.business_kpis(df, found.metrics).first().total_revenue is None


def test_margin_is_null_without_revenue(spark):
    df = spark.createDataFrame([(0.0, 5.0)], "r double, c double")
    kpi = metrics.business_kpis(df, {"revenue": Metric("r"), "cost": Metric("c")}).first()
    assert kpi.gross_margin is None and kpi.total_profit == -5.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "r double, p string")
    kpi = metrics.business_kpis(df, {"revenue": Metric("r")}).first()
    assert (kpi.total_revenue, kpi.transaction_count, kpi.average_order_value) == (0.0, 0, None)
    assert rows(metrics.metric_by_dimension(df, "p", Metric("r"))) == []


def test_dimension_ties_nulls_and_zero_groups(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), (None, 3.0), ("z", 0.0), ("c", 9.0)], "product_name string, v double")
    top = rows(metrics.metric_by_dimension(df, "product_name", Metric("v")))
    assert top == [("c", 9.0), ("a", 5.0), ("b", 5.0), ("Unknown", 3.0)]
    # The limit applies before zero groups go.
    assert rows(metrics.metric_by_dimension(df, "product_name", Metric("v"), limit=5)) == top
    assert metrics.metric_by_dimension(df, "product_name", Metric("v")).columns[0] == "product"


def test_money_sums_are_exact(spark):
    df = spark.range(1000).selectExpr("0.1D AS v")
    assert metrics.business_kpis(df, {"revenue": Metric("v")}).first().total_revenue == 100.0


def test_product_growth(trend):
    growth = metrics.product_growth(trend, "Date", "Product", Metric("Sales"))
    assert rows(growth) == [("Oil", 400.0, 900.0, 500.0, 125.0), ("Rice", 300.0, 100.0, -200.0, -66.67)]
    assert rows(metrics.growth_table(growth)) == [("Oil", 400.0, 900.0, 500.0, 125.0)]
    assert rows(metrics.declining_products(growth))[0][0] == "Rice"


def test_growth_needs_two_periods(ledger):
    assert rows(metrics.product_growth(ledger, "Date", "Item", SIGNED)) == []


def test_growth_from_zero_has_no_percentage(spark):
    df = spark.createDataFrame([("2026-01-01", "a", 1.0), ("2026-02-01", "b", 4.0)], "d string, p string, v double")
    by_product = {r.product: r for r in metrics.product_growth(df, "d", "p", Metric("v")).collect()}
    assert by_product["b"].pct_growth is None and by_product["b"].absolute_growth == 4.0


def test_declining_shown_when_nothing_grows(spark):
    df = spark.createDataFrame([("2026-01-01", "a", 9.0), ("2026-02-01", "a", 4.0)], "d string, p string, v double")
    growth = metrics.product_growth(df, "d", "p", Metric("v"))
    assert rows(metrics.growth_table(growth)) == [("a", 9.0, 4.0, -5.0, -55.56)]


def test_weighted_rows_equal_raw_rows(spark):
    raw = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0)], "product string, v double")
    summed = raw.groupBy("product").agg({"v": "sum", "*": "count"}).toDF("product", "v", "n")
    given = {"revenue": Metric("v")}
    assert metrics.business_kpis(summed, given, rows="n").first() == metrics.business_kpis(raw, given).first()


def test_trending_growth_and_limits(spark):
    df = spark.createDataFrame([
        ("2026-01-05", "Alpha", 400.0), ("2026-02-05", "Alpha", 200.0), ("2026-02-06", "Beta", 250.0),
        ("2026-03-05", "Alpha", 900.0), ("2026-03-06", "Beta", 120.0), ("2026-03-07", "New", 5.0),
    ], "d string, p string, v double")
    trending = rows(ranking.trending(df, "p", "v", "d"))
    assert trending == [("Alpha", 900.0, 200.0, 350.0), ("New", 5.0, 0.0, 100.0), ("Beta", 120.0, 250.0, -52.0)]
    one_month = df.where("d >= '2026-03-01'")
    assert rows(ranking.trending(one_month, "p", "v", "d"))[0] == ("Alpha", 900.0, None, None)


def test_share_of_positive_values(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", -5.0)], "k string, v double")
    shares = {r.k: r.share_pct for r in metrics.revenue_share(df, "k", Metric("v"), "k").collect()}
    assert shares == {"a": 75.0, "b": 25.0, "c": 0.0}
