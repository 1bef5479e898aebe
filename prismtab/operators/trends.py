"""Trends over calendar buckets. Windows run over buckets, never over raw rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismtab.functions.coerce import mean, measure, numeric_columns, plain_number, timestamp
from prismtab.functions.periods import bucket, bucket_label, spine
from prismtab.functions.rounding import half_up, money_round


def trend_grain(df: DataFrame, date: str) -> str:
    """Days up to 45 distinct days, weeks up to 180, else months."""
    days = df.select(F.to_date(timestamp(df, date)).alias("d")).agg(F.count_distinct("d")).first()[0]
    return "day" if days <= 45 else "week" if days <= 180 else "month"


def trend_series(
    df: DataFrame, date: str, columns: list[str] | None = None, grain: str | None = None, most: int | None = None,
) -> DataFrame:
    """(column_name, bucket, value): mean per bucket of the numeric columns, of the first `most` if that is given.

    One aggregate holds all columns. Columns with fewer than two buckets are left out."""
    names = (numeric_columns(df) if columns is None else columns)[:most]
    grain = grain or trend_grain(df, date)
    lines = df.select(
        bucket(timestamp(df, date), grain).alias("_start"),
        *[plain_number(df, name).alias(f"c{i}") for i, name in enumerate(names)],
    ).where(F.col("_start").isNotNull())
    wide = lines.groupBy("_start").agg(*[mean(df, n, f"c{i}").alias(f"c{i}") for i, n in enumerate(names)])
    long = wide.select(
        bucket_label(F.col("_start"), grain).alias("bucket"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("value"))
                           for i, n in enumerate(names)])),
    ).where(F.col("value").isNotNull())
    buckets = F.count(F.lit(1)).over(Window.partitionBy("column_name"))
    return long.withColumn("_n", buckets).where(F.col("_n") >= 2).select("column_name", "bucket", "value")


def trend_points(series: DataFrame) -> DataFrame:
    return series.select("column_name", F.col("bucket").cast("string").alias("bucket"),
                         half_up(F.col("value"), 6).alias("value")).orderBy("column_name", "bucket")


def trend_slope(series: DataFrame) -> DataFrame:
    """Slope of a straight line through the buckets in order, and its direction."""
    at = F.row_number().over(Window.partitionBy("column_name").orderBy("bucket")) - 1
    fitted = series.withColumn("_x", at.cast("double")).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("buckets"), F.regr_slope("value", "_x").alias("_slope"))
    slope = F.col("_slope")
    return fitted.select(
        "column_name", "buckets", half_up(slope, 6).alias("slope"),
        F.when(slope > 0, "up").when(slope < 0, "down").otherwise("flat").alias("direction"))


def trend_change(series: DataFrame) -> DataFrame:
    """First and last bucket, their difference, and the spread of the buckets."""
    ends = series.groupBy("column_name").agg(
        F.min_by("value", "bucket").alias("_first"), F.max_by("value", "bucket").alias("_last"),
        F.stddev_samp("value").alias("_spread"))
    first, change = F.col("_first"), F.col("_last") - F.col("_first")
    return ends.select(
        "column_name", half_up(first, 6).alias("first_value"), half_up(F.col("_last"), 6).alias("last_value"),
        half_up(change, 6).alias("absolute_change"),
        half_up(F.try_divide(change, F.abs(first)) * 100, 6).alias("percent_change"),
        half_up(F.col("_spread"), 6).alias("volatility"))


def trend_anomalies(series: DataFrame, z_limit: float = 2.5, most: int = 10) -> DataFrame:
    """Buckets far from the mean of their column: the first ten by date."""
    per = Window.partitionBy("column_name")
    spread = F.stddev_samp("value").over(per)
    scored = series.select("column_name", "bucket", "value", F.try_divide(
        F.col("value") - F.avg("value").over(per), spread).alias("_z")).where(F.abs("_z") >= z_limit)
    order = F.row_number().over(Window.partitionBy("column_name").orderBy("bucket"))
    return scored.withColumn("_at", order).where(F.col("_at") <= most).select(
        "column_name", F.col("bucket").cast("string").alias("bucket"),
        half_up(F.col("value"), 6).alias("value"), half_up(F.col("_z"), 6).alias("z_score"))


def trend_tail(series: DataFrame, last: int = 100) -> DataFrame:
    """The last buckets of every column, as a chart shows them."""
    order = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("bucket")))
    return trend_points(series.withColumn("_at", order).where(F.col("_at") <= last))


def filled_periods(df: DataFrame, date: str, value: str, grain: str) -> DataFrame:
    """(start, total, lines): sums per period with 0 for periods without rows.

    ``lines`` is the number of rows used in all periods."""
    lines = df.select(bucket(timestamp(df, date), grain).alias("start"), measure(df, value).alias("_value")).where(
        F.col("start").isNotNull() & F.col("_value").isNotNull())
    sums = lines.groupBy("start").agg(F.sum("_value").alias("total"), F.count(F.lit(1)).alias("_n"))
    # One row per calendar period from here on: zeros for every period join the sums that exist.
    zero = F.lit(0).cast(sums.schema["total"].dataType)
    every = spine(F.min("start"), F.max("start"), grain)
    whole = sums.agg(
        F.collect_list(F.struct("start", "total")).alias("known"),
        F.transform(every, lambda s: F.struct(s.alias("start"), zero.alias("total"))).alias("empty"),
        F.sum("_n").alias("lines"),
    )
    return whole.select("lines", F.inline(F.concat("known", "empty"))).groupBy("start").agg(
        F.sum("total").alias("total"), F.max("lines").alias("lines"))


def trend_gapfilled(df: DataFrame, date: str, value: str, grain: str = "month") -> DataFrame:
    """Summed value per period, gaps as 0. Weeks are labelled by their Sunday, others by the first day."""
    start = F.col("start")
    shown = F.date_add(start, 6) if grain == "week" else start
    return filled_periods(df, date, value, grain).orderBy("start").select(
        shown.cast("string").alias("period"), money_round(F.col("total")).alias(value))


def first_to_last(df: DataFrame, date: str, value: str, grain: str = "month") -> DataFrame:
    """Growth from the first to the last period; null when the first is 0 or there is only one."""
    ends = filled_periods(df, date, value, grain).agg(
        F.count(F.lit(1)).alias("periods"), F.min_by("total", "start").alias("_a"),
        F.max_by("total", "start").alias("_b"))
    first, last = (money_round(F.col(c)) for c in ("_a", "_b"))
    growth = F.when(F.col("periods") >= 2, F.try_divide(last - first, F.abs(first)) * 100)
    return ends.select("periods", first.alias("first_value"), last.alias("last_value"),
                       half_up(growth, 2).alias("growth_pct"))


def single_period_warning(by_period: DataFrame) -> DataFrame:
    """One row saying whether a trend can be read from a period table at all."""
    return by_period.agg(F.count(F.lit(1)).alias("periods")).select(
        "periods", (F.col("periods") == 1).alias("single_period"))
