"""Base views over the star-schema tables.

Every view reads only the columns its caller names and joins only the tables behind them. Nothing
is broadcast by hint: Spark broadcasts a side when its measured size allows and otherwise joins by
sort, splitting skewed keys at run time.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_DIMENSIONS = {"product": "p_name", "category": "p_type", "brand": "p_brand"}
CUSTOMER_DIMENSIONS = ("customer", "country", "region")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _price(value: str) -> Column:
    return F.col(value).cast("decimal(12,2)")


def line_revenue() -> Column:
    """Price after discount, exact."""
    kept = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    return (_price("l_extendedprice") * kept).cast("decimal(18,4)")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))


def customer_dimension(spark: SparkSession, sf_dir: str, columns: Iterable[str]) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_name", "customer")
    if {"country", "region"} & set(columns):
        places = geography(spark, sf_dir)
        customers = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.select("c_custkey", *columns)


def sales_totals(
    spark: SparkSession, sf_dir: str, dimensions: list[str], measures: Iterable[str] = ("revenue",),
) -> DataFrame:
    """Sales summed per foreign key before any join, with `rows` as the number of source rows.

    Lines are added up per part or per order first (map-side, so a key with a third of all lines
    sends one row per task), and only then meet the dimension, already placed by the join key.
    """
    measures = set(measures)
    costs = bool(measures & {"cost", "profit"})
    part_columns = [d for d in dimensions if d in PART_DIMENSIONS]
    customer_columns = [d for d in dimensions if d in CUSTOMER_DIMENSIONS]
    dated = "order_date" in dimensions
    keys = []
    if part_columns or costs:
        keys.append("l_partkey")
    if customer_columns or dated:
        keys.append("l_orderkey")

    lines = table(spark, sf_dir, "lineitem").select(
        *keys, line_revenue().alias("revenue"), _price("l_quantity").alias("quantity"), F.lit(1).alias("rows"))
    # Pairs of part and order hardly repeat, so summing them first would only add a shuffle.
    facts = _sum_up(lines, keys) if len(keys) == 1 else lines
    if "l_orderkey" in keys:
        orders = table(spark, sf_dir, "orders").select(
            "o_orderkey", *(["o_custkey"] if customer_columns else []),
            *([F.col("o_orderdate").alias("order_date")] if dated else []))
        facts = facts.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
        if customer_columns:
            if "l_partkey" not in keys:
                facts = _sum_up(facts, ["o_custkey", *(["order_date"] if dated else [])])
            customers = customer_dimension(spark, sf_dir, customer_columns)
            facts = facts.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    if "l_partkey" in keys:
        parts = table(spark, sf_dir, "part").select(
            "p_partkey", "p_retailprice", *[F.col(PART_DIMENSIONS[d]).alias(d) for d in part_columns])
        facts = facts.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    if costs:
        facts = facts.withColumn("cost", _price("p_retailprice") * F.col("quantity"))
        facts = facts.withColumn("profit", F.col("revenue") - F.col("cost"))
    kept = [m for m in ("revenue", "quantity", "cost", "profit") if m in measures]
    return facts.select(*dimensions, *kept, "rows")


def star_sums(spark: SparkSession, sf_dir: str, metrics: dict[str, str]) -> DataFrame:
    """(metric, value, revenue): sales by part and by place from one pass over the lines.

    Grouping sets add the lines up for each foreign key; each set meets its own dimension afterwards. The rows of the
    other set pass a join under a key of their own that no row has, so they do not meet in one task.
    `metrics` names the metric of the columns `category` and `region`."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", line_revenue().alias("revenue"))
    sums = lines.groupingSets([["l_partkey"], ["l_orderkey"]], "l_partkey", "l_orderkey").agg(
        F.sum("revenue").alias("revenue"), F.grouping("l_partkey").alias("_by_order"))
    by_part = F.col("_by_order") == 0
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    places = customer_dimension(spark, sf_dir, ["region"])

    def own_key(key: str, spread: str) -> Column:
        return F.coalesce(F.col(key), -1 - F.xxhash64(spread).bitwiseAND(F.lit((1 << 62) - 1)))

    met = sums.join(parts, own_key("l_partkey", "l_orderkey") == F.col("p_partkey"), "left")
    met = met.join(orders, own_key("l_orderkey", "l_partkey") == F.col("o_orderkey"), "left")
    met = met.join(places, own_key("o_custkey", "l_partkey") == F.col("c_custkey"), "left")
    found = F.when(by_part, F.col("p_partkey").isNotNull()).otherwise(F.col("c_custkey").isNotNull())
    return met.where(found).select(
        F.when(by_part, metrics["category"]).otherwise(metrics["region"]).alias("metric"),
        F.when(by_part, F.col("category")).otherwise(F.col("region")).alias("value"), "revenue")


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text: day first, month first, and both readings the same."""
    day = F.col("o_orderdate")
    same = F.concat_ws("/", F.month(day), F.month(day), F.year(day))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.date_format(day, "d/M/yyyy").alias("day_first"),
        F.date_format(day, "M-d-yyyy").alias("month_first"), same.alias("alike"),
        F.when(F.col("o_orderkey") % 10 > 0, F.date_format(day, "dd/MM/yy HH:mm")).alias("short"))


def large_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line amounts of which some have sixteen digits and some three hundred."""
    number = F.col("l_linenumber")
    amount = F.when(number == 6, F.col("l_quantity") * 2.0 ** 50).when(number == 7, F.lit(2.0 ** 1000)).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select((number % 3).cast("string").alias("store"), "l_returnflag", amount.alias("amount"))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line amounts with NaN and infinities, and cells as reports write them."""
    number, price = F.col("l_linenumber"), F.col("l_extendedprice")
    value = F.when(number == 7, float("inf")).when(number == 6, float("nan")).when(number == 5, float("-inf")).otherwise(price / 7)
    cell = F.when(number == 1, F.concat(F.lit("  "), price.cast("string"), F.lit(" "))).when(number == 2, "   ").when(number == 3, " n/a ")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), number.alias("line_no"), value.alias("ratio"), cell.alias("cell"))


def _sum_up(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in ("revenue", "quantity", "rows")])


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line with its numbers, no join."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("gross_sales"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("return_flag"), F.col("l_linestatus").alias("line_status"),
        F.col("l_shipdate").alias("ship_date"),
    )


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a unit price and no sales column: revenue has to be derived.

    Lines are summed per part first; quantity times price is the same for the sum."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", _price("l_quantity").alias("quantity"))
    sums = lines.groupBy("l_partkey").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("rows"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return sums.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("item"), "quantity", F.col("p_retailprice").alias("unit_price"), "rows")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a type word in mixed case and amounts as text.

    Every seventh kind of line writes its amount as ``Rs 1,234.50``, which is no plain number."""
    flag, status, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    kind = F.when(flag == "N", "SALES").when(flag == "A", "EXPENSE").when(
        status == "O", "UDHAAR").otherwise("REFUND")
    written = F.when(number % 2 == 0, F.concat(F.lit(" "), F.lower(kind), F.lit(" "))).otherwise(kind)
    price = F.col("l_extendedprice")
    amount = F.when(number == 7, F.concat(F.lit("Rs "), F.format_number(price, 2))).otherwise(price.cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entry_id"), number.alias("line_no"), F.col("l_shipdate").alias("date"),
        written.alias("category"), F.concat(F.lit("Item#"), F.col("l_suppkey").cast("string")).alias("item"),
        amount.alias("amount"),
    )


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    website = F.when(key % 5 == 1, F.lit(" ")).when(
        key % 5 != 0, F.concat(F.lit("https://c"), key.cast("string"), F.lit(".example")))
    employees = F.when(balance < 0, None).when(balance < 2000, "1-10").when(balance < 4000, "11-50").when(
        balance < 6000, "51-200").when(balance < 8000, "201-500").otherwise("Enterprise")
    revenue = F.when(key % 7 == 0, "$100K-$500K").when(key % 7 == 1, "10M-50M").when(
        key % 7 == 2, "50M-100M").when(key % 7 == 3, "100M+").when(key % 7 == 4, "$1M").when(key % 7 == 5, " ")
    customers = table(spark, sf_dir, "customer")
    return customers.join(geography(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("business_id"), F.col("c_name").alias("business_name"), website.alias("website"),
        employees.alias("employee_range"), revenue.alias("revenue_range"), "country", "region",
        F.when(key % 11 != 0, F.col("c_mktsegment")).alias("industry"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, with the spend of those that have orders: orders are summed before the join."""
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(_price("o_totalprice")).alias("spend"), F.min("o_orderdate").alias("signup_date"))
    people = table(spark, sf_dir, "customer").join(
        geography(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return people.join(spend, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_name").alias("customer"), "country", F.col("c_mktsegment").alias("segment"), "signup_date",
        F.col("spend"))


def finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").alias("transaction_date"),
        F.col("o_orderpriority").alias("account"), F.col("o_orderstatus").alias("category"),
        F.when(closed, F.col("o_totalprice")).alias("expense"),
        F.when(~closed, F.col("o_totalprice")).alias("income"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("entry_no"),
        F.concat(F.lit(" "), F.col("p_name")).alias("food_name"),
        F.when(key % 11 != 0, F.col("p_type")).alias("category"),
        F.when(key % 13 == 0, F.lit("  ")).otherwise(F.col("p_brand")).alias("cuisine"),
        F.col("p_size").alias("calories"), F.col("p_retailprice").alias("price"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls, blanks, bad numbers and bad dates by the remainder of their key."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ORD-"), key.cast("string")).alias("order_ref"),
        F.when(key % 50 == 0, None).when(key % 50 == 1, "not a date").otherwise(day).alias("order_date"),
        F.when(key % 7 == 0, None).when(key % 7 == 1, " ").otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.when(key % 11 == 0, None).when(key % 11 == 1, "n/a").otherwise(
            F.col("o_totalprice").cast("string")).alias("amount"),
        F.when(key % 13 != 0, F.col("o_totalprice")).alias("total"),
        F.col("o_custkey").alias("custkey"),
        F.lit("web").alias("channel"),
    )


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line attributes without keys: many rows are equal."""
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per line: attributes, sales, profit and a flag, for training."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("line_status"), line_revenue().cast("double").alias("total_sales"),
        (F.col("l_returnflag") == "R").alias("stockout_flag"))
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("category"), F.col("p_retailprice").alias("unit_price"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
    return joined.withColumn("profit", F.col("total_sales") - F.col("unit_price") * F.col("quantity"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as actual classes with a second label standing in for the predicted class."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("actual"), F.col("toxic").cast("string").alias("predicted"))


def line_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List price times quantity standing in for a prediction of the line price."""
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    return lines.select(F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 2100.0).alias("predicted"))


def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as comma-separated lines with too many, too few, quoted and blank cells."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    full = F.concat_ws(",", key, name, "p_brand", F.col("p_size").cast("string"))
    quoted = F.concat(key, F.lit(',"'), name, F.lit(', ""boxed""",'), F.col("p_brand"), F.lit(",1"))
    kind = F.col("p_partkey") % 5
    line = F.when(F.col("p_partkey") % 17 == 0, ", ,").when(kind == 0, F.concat(full, F.lit(",extra,more"))).when(
        kind == 1, F.concat_ws(",", key, name)).when(kind == 3, quoted).otherwise(full)
    return table(spark, sf_dir, "part").select(line.alias("value"))


def multiline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the lines of three files of comma-separated records with line breaks in quoted cells; blocks of
    ten places cut through records."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    kind = F.col("p_partkey") % 4
    quoted = F.concat(key, F.lit(',"'), name, F.lit('\n""boxed"", second line\n\n",'), F.col("p_brand"), F.lit("\n"))
    broken = F.concat(key, F.lit(', "'), name, F.lit('\n, third" ,5" wide'))
    record = F.when(kind == 0, quoted).when(kind == 1, broken).otherwise(F.concat_ws(",", key, name, "p_brand"))
    at = F.col("p_partkey") * 8 + F.col("pos")
    place = F.struct(F.floor(at / 10).cast("bigint").alias("block"), at.cast("bigint").alias("at"))
    lines = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(record, "\n")).alias("pos", "value"))
    return lines.select((F.col("p_partkey") % 3).alias("source"), place.alias("line_no"), "value")


def part_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(*[F.col(c).cast("string").alias(c) for c in parts.columns])


REPORT_HEADER = ["Date", "Category", "Item/Customer", "Amount"]


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report export per order, as lines: title, facts, summary, table, sometimes a closing note."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    total = F.col("o_totalprice")
    lines = [
        F.lit("Ledger Report"), F.concat(F.lit("Shop Name,Shop "), F.col("o_custkey").cast("string")),
        F.concat(F.lit("Generated At,"), day), F.lit(""), F.lit("Summary"),
        F.concat(F.lit('Total Sales,"Rs '), F.format_number(total, 2), F.lit('"')),
        F.lit("Profit Status,Profit"), F.lit("Transaction Details"), F.lit(",".join(REPORT_HEADER)),
        F.concat(day, F.lit(',SALES,"Rice, 5kg",'), total.cast("string")),
        F.concat(day, F.lit(",EXPENSE,Rent,"), F.col("o_custkey").cast("string")),
        F.when(key % 3 == 0, F.lit("Note,printed by till 1")), F.when(key % 3 == 0, F.concat(day, F.lit(",SALES,Late,1"))),
    ]
    return table(spark, sf_dir, "orders").select(
        key.alias("source"), F.posexplode(F.array(*lines)).alias("line_no", "value")).where(F.col("value").isNotNull())


def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dataset_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"))
