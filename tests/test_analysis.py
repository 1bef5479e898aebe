"""The full analysis picks the tables its columns allow."""
from prismtab.plans.analysis import analyze


def check(analysis, *names):
    assert set(names) <= set(analysis.tables), set(names) - set(analysis.tables)
    for name in names:
        analysis.tables[name].collect()


def test_sales(spark):
    df = spark.createDataFrame([
        (f"2026-0{1 + i % 3}-05", f"P{i % 2}", "c" if i % 3 else "d", "north", f"C{i % 5}", str(i % 7), 10 * i) for i in range(40)
    ], "order_date string, product_name string, category string, region string, customer_id string, quantity string, revenue int")
    found = analyze(df, target="revenue")
    assert found.table_type == "sales" and found.model.status == "complete"
    check(found, "kpis", "revenue_by_month", "product_growth", "trending_products", "total_sales", "trend_slope", "model_scores",
          "region_performance", "quantity_by_product")


def test_ledger(spark):
    df = spark.createDataFrame([("2026-05-01", "SALES", "Rice", 5), ("2026-06-01", "EXPENSE", "Rent", 2), ("2026-06-02", "SALES", "Oil", 1)],
                               "`Date` string, `Category` string, `Item/Customer` string, `Amount (Rs)` int")
    found = analyze(df)
    assert (found.table_type, found.metric_type) == ("ledger_transactions", "transaction_ledger")
    assert found.tables["kpis"].first().total_revenue == 6.0
    check(found, "ledger_summary", "expenses")


def test_leads_customers_finance_catalog(spark):
    leads = spark.createDataFrame([("Acme", None, "201-500", "10M", "SA", "Trade")],
                                  "business_name string, website string, employees string, revenue_range string, country string, industry string")
    check(analyze(leads), "leads", "leads_by_country", "no_website")
    people = spark.createDataFrame([("Alice", "a@x", "SA", 5, "vip")], "customer_name string, email string, country string, spend int, segment string")
    check(analyze(people), "top_customers", "customer_locations")
    money = spark.createDataFrame([("2026-01-01", "Bank", 5, 9, "Rent")] * 2, "transaction_date string, account string, expense int, income int, category string")
    check(analyze(money), "finance_expense", "finance_income_expense", "finance_monthly")
    menu = spark.createDataFrame([("Biryani", "rice", "Asian", "hot", 300)], "food_name string, main_ingredient string, cuisine string, spice_level string, calories int")
    check(analyze(menu), "catalog_frequency", "catalog_stats")


def test_generic(spark):
    found = analyze(spark.createDataFrame([("a", 1, "x")], "Name string, Score int, Notes string"))
    assert found.table_type == "generic" and found.tables["kpis"].first().total_revenue is None
    assert "no_revenue: no column or pair of columns stands for revenue" in found.limitations
    check(found, "column_profile")
