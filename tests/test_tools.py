"""Trends, ledgers, leads, customers, finance, catalogs and filters on small frames."""
import numpy as np
import pandas as pd
import pytest

from prismtab.operators import catalog, comparison, customers, filters, finance, leads, ledger, ranking, trends
from prismtab.operators.ledger import LedgerColumns


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def daily(spark, values, start="2026-01-01"):
    days = pd.date_range(start, periods=len(values))
    return spark.createDataFrame([(str(d.date()), float(v)) for d, v in zip(days, values)], "d string, v double")


def test_grain_follows_the_number_of_days(spark):
    assert [trends.trend_grain(daily(spark, range(n)), "d") for n in (45, 46, 180, 181)] == ["day", "week", "week", "month"]


def test_weekly_buckets_equal_pandas(spark):
    values = np.arange(60) ** 1.5
    got = rows(trends.trend_points(trends.trend_series(daily(spark, values), "d", ["v"])))
    want = pd.Series(values, index=pd.date_range("2026-01-01", periods=60)).resample("W").mean()
    assert got == [("v", str(day.date()), round(v, 6)) for day, v in want.items()]


def test_slope_change_and_direction(spark):
    series = trends.trend_series(daily(spark, [1, 3, 2, 6, 8]), "d", ["v"])
    slope = np.polyfit(range(5), [1, 3, 2, 6, 8], 1)[0]
    assert rows(trends.trend_slope(series)) == [("v", 5, round(slope, 6), "up")]
    assert rows(trends.trend_change(series)) == [("v", 1.0, 8.0, 7.0, 700.0, round(np.std([1, 3, 2, 6, 8], ddof=1), 6))]


def test_one_bucket_is_no_trend_and_zero_start_has_no_percentage(spark):
    assert rows(trends.trend_series(daily(spark, [5]), "d", ["v"])) == []
    series = trends.trend_series(daily(spark, [0, 5]), "d", ["v"])
    assert trends.trend_change(series).first().percent_change is None


def test_anomalies(spark):
    series = trends.trend_series(daily(spark, [1.0] * 20 + [50.0]), "d", ["v"])
    found = trends.trend_anomalies(series).collect()
    assert [(r.bucket, r.value) for r in found] == [("2026-01-21", 50.0)] and found[0].z_score > 2.5
    flat = trends.trend_series(daily(spark, [1.0] * 5), "d", ["v"])
    assert rows(trends.trend_anomalies(flat)) == []


def test_gaps_are_filled_with_zero(spark):
    df = spark.createDataFrame([("2026-01-15", 5.0), ("2026-04-02", 7.0), ("bad", 1.0)], "d string, v double")
    assert rows(trends.trend_gapfilled(df, "d", "v")) == [
        ("2026-01-01", 5.0), ("2026-02-01", 0.0), ("2026-03-01", 0.0), ("2026-04-01", 7.0)]
    assert rows(trends.first_to_last(df, "d", "v")) == [(4, 5.0, 7.0, 40.0)]
    weeks = rows(trends.trend_gapfilled(df, "d", "v", "week"))
    want = pd.Series([5.0, 7.0], index=pd.to_datetime(["2026-01-15", "2026-04-02"])).resample("W").sum()
    assert weeks == [(str(day.date()), v) for day, v in want.items()]


def test_period_texts_equal_pandas(spark):
    df = spark.createDataFrame([("2026-05-01", 1.0)], "d string, v double")
    day = pd.Timestamp("2026-05-01")
    for grain, code in (("day", "D"), ("week", "W"), ("month", "M"), ("year", "Y"), ("quarter", "Q")):
        assert ranking.revenue_trend(df, "d", "v", grain).first().period == str(day.to_period(code))
    with pytest.raises(ValueError):
        ranking.revenue_trend(df, "d", "v", "hour")


def test_date_formats(spark):
    days = ["2026-05-01", "2026/05/01", "5/1/2026", "2026-05-01 13:00:00", "2026-05-01T13:00:00Z", "13/5/2026", "x", "12345", None]
    df = spark.createDataFrame([(d, 1.0) for d in days], "d string, v double")
    # 13/5/2026 tells that the day comes first in this column.
    assert rows(ranking.revenue_trend(df, "d", "v", "day")) == [("2026-01-05", 1.0), ("2026-05-01", 4.0), ("2026-05-13", 1.0)]
    month_first = df.where("d IS NULL OR d <> '13/5/2026'")
    assert rows(ranking.revenue_trend(month_first, "d", "v", "day")) == [("2026-05-01", 5.0)]


LEDGER = LedgerColumns("Date", "Category", "Item/Customer", "Amount (Rs)")


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame([
        ("2026-04-30", "SALES", "Rice", "5000"), ("2026-05-02", "sales", "Oil", "2000"), ("2026-05-03", "EXPENSE", "Rent", "500"),
        ("2026-05-04", "UDHAAR", "Ali", "500"), ("bad", "SALES", "Rice", "Rs 1"),
    ], "`Date` string, `Category` string, `Item/Customer` string, `Amount (Rs)` string")


def test_ledger_tables(book):
    summary = ledger.ledger_summary(book, LEDGER).first()
    assert (summary.total_sales, summary.net_profit, summary.credit_outstanding, summary.sales_transaction_count) == (7000.0, 6500.0, 500.0, 3)
    assert rows(ledger.ledger_revenue(book, LEDGER)) == [("2026-04", 5000.0), ("2026-05", 2000.0)]
    assert rows(ledger.ledger_change(book, LEDGER)) == [(2, 5000.0, 2000.0, -60.0)]
    assert rows(ledger.ledger_items(book, LEDGER, "sales", "item", "sales_revenue")) == [("Rice", 5000.0), ("Oil", 2000.0)]
    assert rows(ledger.type_totals(book, LEDGER))[0] == ("SALES", 7000.0)
    pair = ledger.type_performance(book, LEDGER)
    assert pair["type_totals"].count() == 3 and pair["sales_items"].count() == 2


def test_money_text(spark):
    df = spark.createDataFrame([("Rs 1,234.50",), ("rs5",), ("",), ("abc",), (None,)], "m string")
    assert [r.amount_value for r in ledger.parse_money(df, "m").collect()] == [1234.5, 5.0, None, None, None]


def test_lead_scores(spark):
    df = spark.createDataFrame([
        ("A", "201-500", "$100K-$500K"), ("B", "11-50", "10M-50M"), ("C", None, " "), ("D", "few", "50M"), ("E", "Enterprise", "100M+"),
    ], "name string, e string, r string")
    got = {r.business_name: r.lead_score for r in leads.lead_scores(df, "name", None, None, "e", "r").collect()}
    assert got == {"A": 12, "B": 8, "C": 0, "D": 7, "E": 12}


def test_no_website_counts_once(spark):
    df = spark.createDataFrame([(None,), (" ",), ("",), ("x",)], "w string")
    assert rows(leads.no_website(df, "w")) == [("missing_websites", 3)]
    assert set(leads.outreach(df.selectExpr("w", "w AS n"), "n", None, None, None, None, "w")) == {"leads", "no_website"}


def test_customer_share_is_of_all_spend(spark):
    df = spark.createDataFrame([("Alice", 60.0), ("Bob", 20.0), (None, 20.0)], "customer string, spend double")
    assert rows(customers.top_customers(df, "customer", "spend")) == [("Alice", 60.0, 60.0), ("Bob", 20.0, 20.0)]
    assert set(customers.recommendations(df, "customer", "spend", None)) == {"top_customers"}


def test_finance(spark):
    df = spark.createDataFrame([("Payroll", 500.0, None), ("Software", 350.0, 0.0), (None, 9.0, 2000.0)], "category string, expense double, income double")
    assert rows(finance.expense_summary(df, "expense", "category")) == [("Payroll", 500.0), ("Software", 350.0)]
    assert rows(finance.expense_summary(df, "expense", None)) == [("All expenses", 859.0)]
    assert rows(finance.income_expense(df, "income", "expense")) == [("income", 2000.0), ("expense", 859.0), ("net", 1141.0)]


def test_catalog(spark):
    df = spark.createDataFrame([(" Biryani", 300), ("Biryani ", 310), ("Soup", 90), (" ", 50), (None, None)], "food_name string, calories int")
    assert rows(catalog.catalog_frequency(df)) == [("food_name", "Biryani", 2), ("food_name", "Soup", 1)]
    assert rows(catalog.catalog_stats(df, ["calories"])) == [("calories", 50.0, 310.0, 187.5, 195.0)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Red a.b"), (2, "red axb"), (3, None), (4, "blue")], "k int, t string")
    assert [r.k for r in filters.filter_shown(df, "t", "RED", "k").collect()] == [1, 2]
    assert [r.k for r in filters.filter_rows(df, "t", "a.b").collect()] == [1]
    assert [r.k for r in filters.filter_shown(df, "t", "a.b", "k", literal=False).collect()] == [1, 2]
    assert rows(filters.filter_counts(df, "k", "2")) == [(1, 4)]
    assert rows(filters.filter_value_counts(df, "t"))[0] == ("Red a.b", 1)


def test_insights(spark):
    df = spark.createDataFrame([("a", 90.0), ("b", 3.0), ("c", 3.0), ("d", 2.0), ("e", 2.0)], "g string, v double")
    assert rows(ranking.best_and_worst(df, "g", "v")) == [("a", 90.0, "d", 2.0)]
    assert rows(ranking.concentration(df, "g", "v")) == [(5, 96.0)]
    assert rows(ranking.concentration(df.where("g < 'e'"), "g", "v")) == []
    assert rows(ranking.best_and_worst(df.where("g = 'a'"), "g", "v")) == []


def test_display_safe(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (1.23456789, 3)], "v double, k int")
    assert [r.v for r in filters.display_safe(df).orderBy("k").collect()] == [None, None, 1.234568]


def test_custom_metrics(spark):
    df = spark.createDataFrame([("2026-01-01", "a", 10.0, 2.0), ("2026-02-01", "a", 30.0, 2.0), ("2026-02-02", "b", 5.0, 0.0)],
                               "d string, g string, v double, w double")
    assert sorted(rows(comparison.ratio_metric(df, "v", "w", ["g"]))) == [("a", 10.0), ("b", None)]
    assert rows(comparison.growth_metric(df, "d", "v")) == [("2026-01", 10.0, None), ("2026-02", 35.0, 250.0)]
    tiers = comparison.tier(df, "v", {"Gold": 20, "Bronze": 6}).collect()
    assert [r.tier for r in tiers] == ["Bronze", "Gold", None]
    assert [comparison.single_metric(df, "v", op).first()[0] for op in ("sum", "mean", "count", "median")] == [45.0, 15.0, 3.0, 10.0]
    assert rows(comparison.group_aggregation(df, ["g"], "v", ["sum", "max"], limit=1)) == [("a", 40.0, 30.0)]
    assert rows(comparison.time_series(df, "d", "v", how="sum")) == [("2026-01-31", 10.0), ("2026-02-28", 35.0)]
    assert comparison.scatter_points(df, "v", "w", "g", 2).count() == 2
    assert rows(comparison.scatter_correlation(df.where("g = 'a'"), "v", "w")) == [("all", 2, None, 0)]


def test_segment_tests(spark):
    assert comparison._student_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert comparison._student_p(1.0, 1) == pytest.approx(0.5, abs=1e-6)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 300), rng.integers(1, 10, 200)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 300 + ["b"] * 200, "v": np.concatenate([a, b]).astype(float)}))
    u = comparison.mann_whitney(df, "g", ("a", "b"), "v").first()
    assert u["statistic"] == sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    for test in ("ttest", "mannwhitney"):
        row = comparison.compare_segments(df, "g", ("a", "b"), ["v"], test).first()
        assert row.significant and 0 < row.p_value < 0.01
    same = comparison.compare_segments(df.withColumn("v", df.v * 0), "g", ("a", "b"), ["v"], "mannwhitney").first()
    assert same.p_value == 1.0 and not same.significant


def test_empty_inputs_give_no_periods(spark):
    df = spark.createDataFrame([], "d string, g string, v double")
    assert rows(trends.trend_gapfilled(df, "d", "v")) == []
    assert rows(ranking.recent_growth(df, "d", "v")) == []
    assert rows(ranking.trending(df, "g", "v", "d")) == []
    assert rows(trends.trend_series(df, "d", ["v"])) == []
    assert rows(comparison.welch(df, "g", ("a", "b"), ["v"])) == [("v", 0, 0, None, None, None, None)]
