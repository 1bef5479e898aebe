"""One order of day and month for each column of dates, and distinct counts without text."""
import datetime

from pyspark.sql import functions as F

from prismtab.functions.coerce import timestamp
from prismtab.operators import metrics, profile
from prismtab.operators.metrics import Metric
from prismtab.plans import registry

day = datetime.datetime


def parsed(df, name):
    return [r[0] for r in df.orderBy("i").select(timestamp(df, name)).collect()]


def test_one_order_per_column(spark):
    rows = [(0, "03/04/2024", "03/04/2024", "3-4-24", "2024-04-03"), (1, "13/02/2024", "02/13/2024", "13-2-99 10:30", "x"), (2, None, "bad", " 1/12/68 ", "4/3/2024")]
    df = spark.createDataFrame(rows, "i int, d string, m string, short string, iso string")
    assert parsed(df, "d") == [day(2024, 4, 3), day(2024, 2, 13), None]
    assert parsed(df, "m") == [day(2024, 3, 4), day(2024, 2, 13), None]
    assert parsed(df, "short") == [day(2024, 4, 3), day(1999, 2, 13, 10, 30), day(2068, 12, 1)]
    assert parsed(df, "iso") == [day(2024, 4, 3), None, day(2024, 4, 3)]
    found = {r["column_name"]: (r["month_first"], r["day_first"], r["date_order"]) for r in profile.date_orders(df).collect()}
    assert found == {"d": (1, 2, "day first"), "m": (2, 1, "month first"), "short": (2, 3, "day first"), "iso": (2, 2, "either")}


def test_the_order_reaches_every_operator(spark):
    df = spark.createDataFrame([("01/02/2024", 1.0), ("15/02/2024", 2.0), ("03/03/2024", 4.0)], "d string, v double")
    got = [tuple(r) for r in metrics.metric_by_period(df, "d", Metric("v"), "month").collect()]
    assert got == [("2024-02", 3.0), ("2024-03", 4.0)]


def test_distinct_counts_of_short_types(spark):
    rows = [(1, 0.0, True, day(2024, 1, 1), 1.5, "a"), (2, -0.0, False, day(2024, 1, 1), 1.5, "a"), (None, float("nan"), None, None, None, " "), (2, 2.5, True, day(2024, 1, 2), 7.25, None)]
    df = spark.createDataFrame(rows, "n int, x double, b boolean, t timestamp, y float, s string").withColumns({
        "d": F.col("y").cast("decimal(12,2)"), "wide": F.col("y").cast("decimal(30,2)"), "list": F.array("n")})
    stats = {s.name: s for s in profile.column_stats(df)}
    assert {n: s.distinct for n, s in stats.items()} == {"n": 2, "x": 2, "b": 2, "t": 2, "y": 2, "s": 2, "d": 2, "wide": 2, "list": 3}
    assert (stats["s"].distinct_filled, stats["s"].blanks, stats["x"].nulls) == (1, 2, 1)


def test_numbers_do_not_become_text(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "n int, x double, s string")
    assert [f for f in df.schema.fields if not profile._in_eight_bytes(f.dataType)] == [df.schema["s"]]


def test_lines_are_read_once(spark):
    frame = registry.QUERIES["total_sales_overview"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and frame.count() == 2
