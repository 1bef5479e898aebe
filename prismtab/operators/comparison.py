"""Free-form tools: grouped aggregates, custom metrics, scatter data, comparison of segments."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismtab.functions.coerce import col, measure, number, timestamp
from prismtab.functions.periods import bucket, bucket_label, period_text
from prismtab.functions.rounding import half_up
from prismtab.operators.outliers import iqr_bounds
from prismtab.operators.profile import local_frame
from prismtab.operators.quantiles import exact_quantiles
from prismtab.operators.ranks import totals_before


def _exact_mean(value: str) -> Column:
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def time_series(df: DataFrame, date: str, value: str, grain: str = "month", how: str = "mean") -> DataFrame:
    """Mean, sum or count of a value per bucket that holds rows."""
    lines = df.select(bucket(timestamp(df, date), grain).alias("_start"), measure(df, value).alias("_value")).where(
        F.col("_start").isNotNull() & F.col("_value").isNotNull())
    results = {"mean": half_up(_exact_mean("_value"), 6), "sum": half_up(F.sum("_value").cast("double"), 6),
               "count": F.count("_value").cast("double")}
    return lines.groupBy("_start").agg(results[how].alias("value")).orderBy("_start").select(
        bucket_label(F.col("_start"), grain).cast("string").alias("bucket"), "value")


def group_aggregation(
    df: DataFrame, groups: list[str], value: str, functions: list[str] | None = None,
    sort_by: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Named aggregates of one column per group, the largest of `sort_by` first."""
    known = {"sum": half_up(F.sum("_value").cast("double"), 6), "mean": half_up(_exact_mean("_value"), 6), "count": F.count("_value"),
             "min": F.min("_value").cast("double"), "max": F.max("_value").cast("double")}
    wanted = functions or ["mean"]
    lines = df.select(*map(col, groups), measure(df, value).alias("_value"))
    table = lines.groupBy(*map(col, groups)).agg(*[known[f].alias(f"{value}_{f}") for f in wanted])
    order = [F.desc(col(sort_by or f"{value}_{wanted[0]}")), *[F.asc(col(g)) for g in groups]]
    return table.orderBy(*order) if limit is None else table.orderBy(*order).limit(limit)


def scatter_correlation(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Points, correlation and outliers (of y) per color, or for all rows."""
    bounds = iqr_bounds(df, [y]).get(y)
    b = F.col("_y")
    outside = (b < bounds[0]) | (b > bounds[1]) if bounds else F.lit(False)
    key = col(color).cast("string") if color else F.lit("all")
    points = df.select(key.alias("color"), number(df, x).alias("_x"), number(df, y).alias("_y")).where(
        F.col("_x").isNotNull() & b.isNotNull())
    spread = F.stddev_pop("_x") * F.stddev_pop("_y")
    return points.groupBy("color").agg(
        F.count(F.lit(1)).alias("points"), half_up(F.try_divide(F.covar_pop("_x", "_y"), spread), 6).alias("correlation"),
        F.count_if(outside).alias("outliers"))


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None, max_points: int | None = None) -> DataFrame:
    """All points, or a sample of `max_points` with the smallest row hash if that is given."""
    columns = [col(x), col(y), *([col(color)] if color else [])]
    filled = df.select(*columns).where(col(x).isNotNull() & col(y).isNotNull())
    return filled if max_points is None else filled.orderBy(F.xxhash64(*columns), *columns).limit(max_points)


def ratio_metric(df: DataFrame, numerator: str, denominator: str, groups: list[str] = ()) -> DataFrame:
    """Sum over sum, per group or for all rows; null when the denominator is 0."""
    lines = df.select(*map(col, groups), measure(df, numerator).alias("_a"), measure(df, denominator).alias("_b"))
    value = F.try_divide(F.sum("_a").cast("double"), F.sum("_b").cast("double"))
    return lines.groupBy(*map(col, groups)).agg(half_up(value, 6).alias("ratio"))


def growth_metric(df: DataFrame, date: str, value: str, grain: str = "month") -> DataFrame:
    """Summed value per period and its change from the period before in the data."""
    lines = df.select(bucket(timestamp(df, date), grain).alias("_start"), measure(df, value).alias("_value"))
    periods = lines.where(F.col("_start").isNotNull() & F.col("_value").isNotNull()).groupBy("_start").agg(
        F.sum("_value").cast("double").alias("_total"))
    before = F.lag("_total").over(Window.partitionBy(F.lit(0)).orderBy("_start"))  # one row per period
    growth = F.try_divide(F.col("_total") - F.col("_before"), F.abs("_before")) * 100
    return periods.withColumn("_before", before).orderBy("_start").select(
        period_text(F.col("_start"), grain).alias("period"), half_up(F.col("_total"), 2).alias("value"),
        half_up(growth, 2).alias("growth_pct"))


def tier(df: DataFrame, value: str, thresholds: dict[str, float], name: str = "tier") -> DataFrame:
    """A label per row: the highest threshold that the value reaches."""
    number_of = number(df, value)
    label = F.lit(None).cast("string")
    for text, least in sorted(thresholds.items(), key=lambda pair: pair[1]):
        label = F.when(number_of >= least, text).otherwise(label)
    return df.withColumn(name, label)


def single_metric(df: DataFrame, column: str, operation: str) -> DataFrame:
    """One number: sum, mean, count or median."""
    if operation == "median":
        value = exact_quantiles(df, [column], [0.5])[column][0]
        return local_frame(df.sparkSession, [(value,)], "value double")
    lines = df.select(measure(df, column).alias("_value"))
    results = {"sum": half_up(F.coalesce(F.sum("_value"), F.lit(0)).cast("double"), 6), "mean": half_up(_exact_mean("_value"), 6),
               "count": F.count("_value").cast("double")}
    return lines.agg(results[operation].alias("value"))


# --- two segments ------------------------------------------------------------------------------


def _sides(df: DataFrame, segment: str, pair: tuple[str, str], value: str) -> DataFrame:
    kind = col(segment).cast("string")
    return df.where(kind.isin(*pair)).select((kind == pair[0]).alias("_a"), number(df, value).alias("_v")).where(
        F.col("_v").isNotNull())


def welch(df: DataFrame, segment: str, pair: tuple[str, str], values: list[str]) -> DataFrame:
    """Sizes, means, Welch's t and its degrees of freedom per metric, from one aggregate."""
    kind = col(segment).cast("string")
    lines = df.where(kind.isin(*pair)).select(
        (kind == pair[0]).alias("_a"), *[number(df, v).alias(f"v{i}") for i, v in enumerate(values)])

    def sides(i: int) -> list[Column]:
        out = []
        for name, holds in (("a", F.col("_a")), ("b", ~F.col("_a"))):
            v = F.when(holds, F.col(f"v{i}"))
            out += [F.count(v).alias(f"n_{name}{i}"), F.avg(v).alias(f"m_{name}{i}"), F.var_samp(v).alias(f"s_{name}{i}")]
        return out

    row = lines.agg(*[a for i in range(len(values)) for a in sides(i)])
    table = row.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("metric"), *[F.col(f"{c}{i}").alias(c) for c in ("n_a", "n_b", "m_a", "m_b", "s_a", "s_b")])
        for i, v in enumerate(values)])))
    e_a, e_b = F.try_divide("s_a", "n_a"), F.try_divide("s_b", "n_b")
    t = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(e_a + e_b))
    dof = F.try_divide((e_a + e_b) * (e_a + e_b),
                       F.try_divide(e_a * e_a, F.col("n_a") - 1) + F.try_divide(e_b * e_b, F.col("n_b") - 1))
    return table.select("metric", "n_a", "n_b", half_up(F.col("m_a"), 6).alias("mean_a"), half_up(F.col("m_b"), 6).alias("mean_b"),
                        half_up(t, 6).alias("statistic"), half_up(dof, 4).alias("degrees"))


def mann_whitney(df: DataFrame, segment: str, pair: tuple[str, str], value: str) -> DataFrame:
    """Sizes, the U statistic of the first segment and the tie term, exact at any size.

    Equal values are counted together first; what lies below a value is a running total over ranges of values."""
    counts = _sides(df, segment, pair, value).groupBy("_v").agg(
        F.count_if("_a").alias("a"), F.count_if(~F.col("_a")).alias("b"))
    ranked = totals_before(counts, ["_v"], {"below": F.col("b")})
    same = (F.col("a") + F.col("b")).cast("double")
    return ranked.agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"),
        F.sum(F.col("a") * (F.col("below").cast("double") + F.col("b") / F.lit(2.0))).alias("statistic"),
        F.sum(same * same * same - same).alias("tie_term"))


def compare_segments(
    df: DataFrame, segment: str, pair: tuple[str, str], values: list[str], test: str = "ttest", limit: float = 0.05,
) -> DataFrame:
    """Per metric: means, test statistic, two-sided p-value, and whether it is below the limit."""
    rows = []
    for r in welch(df, segment, pair, values).collect():  # one row per metric
        statistic, p = r["statistic"], None
        if test == "mannwhitney":
            u = mann_whitney(df, segment, pair, r["metric"]).first()
            statistic, p = u["statistic"], _rank_p(u)
        elif statistic is not None and r["degrees"]:
            p = _student_p(statistic, r["degrees"])
        rows.append((r["metric"], r["mean_a"], r["mean_b"], statistic, p, None if p is None else p < limit))
    return local_frame(df.sparkSession, rows, (
        "metric string, mean_a double, mean_b double, statistic double, p_value double, significant boolean"))


def _rank_p(u) -> float | None:
    """Normal approximation with tie and continuity correction."""
    a, b = u["n_a"] or 0, u["n_b"] or 0
    n = a + b
    if not a or not b or n < 2:
        return None
    variance = a * b / 12 * ((n + 1) - u["tie_term"] / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    z = max(0.0, abs(u["statistic"] - a * b / 2) - 0.5) / math.sqrt(variance)
    return math.erfc(z / math.sqrt(2))


def _student_p(t: float, degrees: float) -> float:
    """Two-sided tail of Student's t: the incomplete beta function of (degrees/2, 1/2) as a continued
    fraction. From 10^5 degrees on, t is turned into a normal value with the error of degrees^-2."""
    if math.isinf(t):
        return 0.0
    if degrees > 1e5:
        normal = abs(t) * (1 - 1 / (4 * degrees)) / math.sqrt(1 + t * t / (2 * degrees))
        return math.erfc(normal / math.sqrt(2))
    a, b, x = degrees / 2, 0.5, degrees / (degrees + t * t)
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    if x == 0:
        return 1.0 if swap else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny, fraction, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        fraction *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    tail = front * (fraction - 1) / a
    return min(1.0, max(0.0, 1 - tail if swap else tail))
