"""Column meaning, kinds of tables and targets."""
import pytest

from prismtab.functions.names import clean_headers
from prismtab.operators import roles, targets
from prismtab.operators.filters import clamp_limit, require
from prismtab.operators.profile import column_stats


def stats_of(spark, data, schema):
    return column_stats(spark.createDataFrame(data, schema))


@pytest.fixture(scope="module")
def sales(spark):
    days = ["2026-01-05", "2026-02-05", "2026-03-05"]
    return stats_of(spark, [
        (days[i % 3], f"P{i % 2}", "c", "north", f"C{i}", i, 10 * i, i) for i in range(6)
    ], "order_date string, product_name string, category string, region string, customer_id string, quantity int, revenue int, profit int")


def test_sales_roles(sales):
    assert roles.profile_roles(sales) == {
        "order_date": "order_date", "product_name": "product", "category": "category", "region": "region",
        "customer_id": "customer", "quantity": "quantity", "revenue": "sales_amount", "profit": "unknown"}
    found = roles.semantic_columns(sales)
    assert (found["date"], found["revenue"], found["profit"]) == ("order_date", "revenue", "profit")
    assert roles.profile_table_type(sales)[0] == "sales"


def test_leads(spark):
    stats = stats_of(spark, [
        (1, "Acme", None, "201-500", "$10M-$50M", "SA", "Riyadh", "Trade", "b1"), (2, "Bolt", " ", "11-50", "$1M", "AE", "Dubai", "IT", "b2"),
    ], "row_num int, business_name string, business_website string, business_number_of_employees_range string, "
       "business_yearly_revenue_range string, business_country_name string, business_region string, business_naics_description string, business_id string")
    assert list(roles.profile_roles(stats).values()) == [
        "unknown", "business_name", "website", "employee_range", "revenue_range", "country", "region", "industry", "business_id"]
    assert roles.profile_table_type(stats) == ("business_leads", 0.99)


def test_ledger(spark):
    stats = stats_of(spark, [("2026-05-01", "10:00", " sales", "Rice", 5), ("2026-05-02", "11:00", "UDHAAR", "Ali", 7)],
                     "`Date` string, `Time` string, `Category` string, `Item/Customer` string, `Amount (Rs)` int")
    assert roles.is_ledger(stats)
    assert roles.profile_roles(stats)["Item/Customer"] == "conditional_item_customer"
    assert roles.profile_table_type(stats)[0] == "ledger_transactions"
    assert roles.profile_table_type(stats, has_summary=True)[0] == "ledger_report"
    found = roles.metric_map(roles.metric_roles(stats))
    assert found.metrics["revenue"].type_column == "Category" and found.metrics["revenue"].subtract
    assert roles.metric_table_type(stats, roles.metric_roles(stats)) == ("transaction_ledger", 0.92)


@pytest.mark.parametrize("schema, row, revenue, kind", [
    ("Date string, Product string, Category string, Quantity int, UnitPrice double, Sales double",
     ("2026-01-01", "Rice", "g", 1, 2.0, 3.0), "Sales", "mart_sales"),
    ("order_date string, sku string, customer_id string, net_amount double, discount double, region string",
     ("2026-01-01", "s", "c", 3.0, 0.1, "n"), "net_amount", "ecommerce_orders"),
    ("InvoiceDate string, InvoiceNo string, Item string, Qty int, Price double",
     ("2026-01-01", "i", "x", 2, 3.0), "Qty", "invoice_sales"),
    ("food_name string, cuisine string, calories int", ("Biryani", "Asian", 300), None, "food_dataset"),
])
def test_revenue_source_and_table_type(spark, schema, row, revenue, kind):
    stats = stats_of(spark, [row, row], schema)
    given = roles.metric_roles(stats)
    found = roles.metric_map(given).metrics.get("revenue")
    assert (found.column if found else None) == revenue
    assert roles.metric_table_type(stats, given)[0] == kind


def test_id_columns(spark):
    stats = stats_of(spark, [(1, 2, 3, 4, 5)], "product_id int, store_id int, customer_id int, order_id int, row_id int")
    assert list(roles.metric_roles(stats).values()) == ["product", "store", "customer_id", "order_id", "ignore_identifier"]


def test_targets_leave_identifiers_out(spark):
    data = [(f"id{i}", float(i * i), "yes" if i % 3 else "no", i % 2 == 0) for i in range(40)]
    stats = stats_of(spark, data, "customer_name string, revenue double, churned string, flag boolean")
    tasks = {row[0]: row[1] for row in targets.suggestions(stats)}
    assert tasks == {"revenue": "regression", "churned": "classification", "flag": "classification"}
    assert targets.choose_target(stats, "REVENUE")[0] == "revenue"
    assert targets.choose_target(stats, "customer_name") is None
    assert targets.choose_target(stats, at_least=1.0) is None


def test_feature_exclusions(spark):
    data = [(f"u{i}", i, i * 2.0, "x", f"t{i}", i % 3) for i in range(60)]
    stats = stats_of(spark, data, "user_id string, total_sales int, total_sales_net double, same string, words string, ok int")
    reasons = {s.name: targets.exclusion(s, "total_sales") for s in stats}
    assert reasons == {"user_id": "identifier", "total_sales": "target", "total_sales_net": "leakage", "same": "constant",
                       "words": "identifier", "ok": None}


def test_find_column(spark):
    df = spark.createDataFrame([(1, 2)], "`Customer Name` int, lifetime_value int")
    assert roles.find_column(df, ["customer"], {"customer": None}) == "Customer Name"
    assert roles.find_column(df, ["ltv", "lifetime value"], {}) == "lifetime_value"
    assert roles.find_column(df, ["nothing"], {}) is None
    assert roles.fallback_column(df, {"lifetime_value": "profit"}, ["profit"], []) == "lifetime_value"


def test_default_columns_and_tasks(sales):
    assert roles.default_columns(sales) == {"date": "order_date", "value": "revenue", "group": "product_name", "target": "quantity"}
    assert "prediction" not in roles.feasible_tasks(sales) and "trend" in roles.feasible_tasks(sales)


def test_headers_limits_and_requirements(spark):
    assert clean_headers([" a ", "", "b"]) == ["a", "unnamed_1", "b"]
    assert [clamp_limit(v) for v in (None, 0, 7, 99)] == [10, 1, 7, 25]
    with pytest.raises(ValueError, match="revenue"):
        require(spark.range(1), id="id", revenue=None)
