"""The shared statistics pass and the per-column profile built on it.

One two-level grouping of (column, value) pairs gives exact distinct counts and every other count
the column rules need. Only one row of statistics per column reaches the driver.
"""
from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prismtab.functions import vocabulary as words
from prismtab.functions.coerce import (
    DATE_TEXT, DAY_FIRST, MONTH_FIRST, RANGE_TEXT, col, is_date, is_null, is_number, is_text, number, numeric_columns,
    numeric_text, ordered_timestamp, text_columns, upper_trim,
)
from prismtab.functions.names import ascii_snake
from prismtab.functions.rounding import half_up, half_up_value
from prismtab.operators.quantiles import exact_quantiles

# Name parts that mark an identifier.
IDENTIFIER_PARTS = ("id", "uuid", "guid", "email", "phone", "name", "address", "url", "website")

WORD_GROUPS = {
    "sale": words.SALE_VALUES,
    "expense": words.EXPENSE_VALUES,
    "credit": words.CREDIT_VALUES,
    "refund": words.REFUND_VALUES,
    "ledger": (words.LEDGER_SALES, words.LEDGER_EXPENSE, words.LEDGER_CREDIT),
}


@dataclass(frozen=True)
class ColumnStats:
    name: str
    type: str
    kind: str  # number, text, date, bool or other
    rows: int
    nulls: int
    blanks: int  # null, or text of blanks
    numeric_values: int
    date_shaped: int
    date_values: int
    range_shaped: int
    word_groups: frozenset[str]
    distinct: int = 0
    distinct_filled: int = 0  # without blank text
    month_first: int = 0  # values that are dates with the month first, and with the day first
    day_first: int = 0

    @property
    def filled(self) -> int:
        return self.rows - self.nulls

    @property
    def distinct_share(self) -> float:
        return self.distinct / max(1, self.filled)

    @property
    def numeric_like(self) -> bool:
        if self.kind in ("number", "bool"):
            return True
        return self.filled > 0 and self.numeric_values >= max(2, int(self.filled * 0.7))

    @property
    def date_like(self) -> bool:
        """Half of the values look like dates and 55% parse (at least two)."""
        if self.kind != "text":
            return self.kind == "date"
        return (
            self.filled > 0 and self.date_shaped >= max(1, int(self.filled * 0.5))
            and self.date_values >= max(2, int(self.filled * 0.55))
        )

    @property
    def date_like_for_trends(self) -> bool:
        """The looser test of the quality report: some look like dates and 60% parse (at least three)."""
        if self.kind != "text":
            return self.kind == "date"
        return self.date_shaped > 0 and self.date_values >= max(3, int(self.filled * 0.6))

    @property
    def date_hint(self) -> bool:
        """The loosest test: two values parse."""
        if self.kind == "date":
            return self.filled >= 2
        return self.kind == "text" and self.date_shaped > 0 and self.date_values >= 2

    @property
    def range_like(self) -> bool:
        return self.filled > 0 and self.range_shaped >= max(1, int(self.filled * 0.4))

    @property
    def identifier_like(self) -> bool:
        named = identifier_name(self.name)
        plain_text = self.kind not in ("number", "bool")
        if named and (self.distinct_share > 0.65 or plain_text):
            return True
        return plain_text and self.distinct_share > 0.95 and self.filled >= 20

    @property
    def cardinality(self) -> str:
        return cardinality_label(self.distinct_filled if self.kind == "text" else self.distinct, self.rows)


def identifier_name(name: str) -> bool:
    """Whether a column's name may mark an identifier."""
    return any(part in ascii_snake(name) for part in IDENTIFIER_PARTS)


def cardinality_label(distinct: int, rows: int) -> str:
    if rows <= 0:
        return "unknown"
    if distinct <= 1:
        return "constant"
    share = distinct / rows
    for limit, name in ((0.05, "low"), (0.25, "medium"), (0.75, "high")):
        if share <= limit:
            return name
    return "very_high"


def _kind(data_type: T.DataType) -> str:
    for kind, test in (("number", is_number), ("text", is_text), ("date", is_date)):
        if test(data_type):
            return kind
    return "bool" if isinstance(data_type, T.BooleanType) else "other"


def _text_tests(value: Column) -> dict[str, Column]:
    """What the rules ask about one text value."""
    upper = upper_trim(value)
    return {
        "blanks": F.trim(value) == "",
        "numeric_values": numeric_text(value),
        "date_shaped": value.rlike(DATE_TEXT),
        "month_first": ordered_timestamp(value, MONTH_FIRST).isNotNull(),
        "day_first": ordered_timestamp(value, DAY_FIRST).isNotNull(),
        "range_shaped": value.rlike(RANGE_TEXT),
    } | {f"has_{group}": upper.isin(*listed) for group, listed in WORD_GROUPS.items()}


TESTS = ["blanks", "numeric_values", "date_shaped", "month_first", "day_first", "range_shaped",
         *(f"has_{group}" for group in WORD_GROUPS)]


def column_stats(df: DataFrame, distinct: bool = True, approximate: bool = False, uncounted: Collection[str] = ()) -> list[ColumnStats]:
    """Statistics of every column from one pass.

    With exact distinct counts the (column, value) pairs of text are grouped first, so that each test
    runs once per distinct value; values of other types are counted by 64 bits that tell them apart and
    never become text. Without distinct counts, or with ``approximate`` ones from a sketch, the pairs
    are tested as they come and only one row per column and task is shuffled. Beside exact counts, those of numbers in
    ``uncounted`` only tell whether there is no value, one, or more, which is 2."""
    if not df.columns:
        return []
    counted = _value_tests(df, exact=distinct and not approximate, sketch=distinct and approximate, uncounted=uncounted)
    found = []
    for field in df.schema.fields:
        counts, kind = counted[field.name], _kind(field.dataType)
        filled = counts["rows"] - counts["nulls"]
        if kind in ("number", "bool"):
            counts["numeric_values"] = filled
        # One order of day and month for the whole column: the one that fits more values.
        counts["date_values"] = filled if kind == "date" else max(counts["month_first"], counts["day_first"])
        found.append(ColumnStats(
            field.name, field.dataType.simpleString(), kind, counts["rows"], counts["nulls"],
            counts["nulls"] + counts["blanks"],
            *(counts[t] for t in ("numeric_values", "date_shaped", "date_values", "range_shaped")),
            word_groups=frozenset(g for g in WORD_GROUPS if counts[f"has_{g}"]),
            distinct=counts.get("distinct", 0), distinct_filled=counts.get("distinct_filled", 0),
            month_first=counts["month_first"], day_first=counts["day_first"],
        ))
    return found


def _value_tests(df: DataFrame, exact: bool, sketch: bool, uncounted: Collection[str] = ()) -> dict[str, dict[str, int]]:
    """Counts by column name. Only text, and types without a short form, go through (column, value) rows."""
    texts = text_columns(df)
    short = [f.name for f in df.schema.fields if _in_eight_bytes(f.dataType)]
    paired = [name for name in df.columns if name not in short] if exact else texts
    loose = [name for name in short if exact and name in uncounted]
    found = _plain_counts(df, [name for name in df.columns if name not in paired], sketch, loose)
    if exact:
        for name, distinct in _short_distinct(df, [name for name in short if name not in loose]).items():
            found[name] |= {"distinct": distinct, "distinct_filled": distinct}
    if paired:
        found |= _paired_counts(df, paired, texts, exact, sketch)
    keys = ["rows", "nulls", "distinct", "distinct_filled", *TESTS]
    return {name: {key: found.get(name, {}).get(key) or 0 for key in keys} for name in df.columns}


def _in_eight_bytes(data_type: T.DataType) -> bool:
    """Types whose values have at most eight bytes, which xxhash64 maps one to one."""
    if isinstance(data_type, T.DecimalType):
        return data_type.precision <= 18
    return isinstance(data_type, (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _short_distinct(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Exact distinct counts: (column number, 64 bits) pairs, grouped within each task before the shuffle."""
    if not names:
        return {}
    cells = F.array(*[F.when(~is_null(df, name), F.struct(F.lit(i).alias("i"), F.xxhash64(col(name)).alias("bits"))) for i, name in enumerate(names)])
    pairs = df.select(F.inline(cells)).where(F.col("i").isNotNull()).distinct()
    counts = {r["i"]: r["count"] for r in pairs.groupBy("i").count().collect()}  # one row per column
    return {name: counts.get(i, 0) for i, name in enumerate(names)}


def date_orders(df: DataFrame, stats: list[ColumnStats] | None = None) -> DataFrame:
    """Text columns with dates: how many values are dates in each order, and the order the column is read in;
    ``either`` names a column that both orders fit, which is read month first."""
    rows = []
    for s in stats or column_stats(df, distinct=False):
        if s.kind == "text" and s.date_values:
            order = "either" if s.month_first == s.day_first else "day first" if s.day_first > s.month_first else "month first"
            rows.append((s.name, s.month_first, s.day_first, order))
    return local_frame(df.sparkSession, rows, "column_name string, month_first bigint, day_first bigint, date_order string")


def _plain_counts(df: DataFrame, names: list[str], sketch: bool, loose: Collection[str] = ()) -> dict[str, dict[str, int]]:
    if not names:
        return {}
    makers = {"nulls": lambda name: F.count_if(is_null(df, name))}
    if sketch:
        makers["distinct"] = lambda name: F.approx_count_distinct(_value_text(df, name))
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[
        make(name).alias(f"{i}_{key}") for i, name in enumerate(names) for key, make in makers.items()], *[
        part.alias(f"{i}_{key}") for i, name in enumerate(names) if name in loose for key, part in _loose_parts(df, name).items()]).first()
    counts = {name: {"rows": row["rows"]} | {key: row[f"{i}_{key}"] for key in makers} for i, name in enumerate(names)}
    for i, name in enumerate(names):
        if name in loose:
            one = row[f"{i}_least"] == row[f"{i}_most"]
            counts[name]["distinct"] = 0 if row[f"{i}_least"] is None else 1 if one else 2
    return {name: c | {"distinct_filled": c.get("distinct", 0)} for name, c in counts.items()}


def _loose_parts(df: DataFrame, name: str) -> dict[str, Column]:
    value = F.when(~is_null(df, name), col(name))
    return {"least": F.min(value), "most": F.max(value)}


def _paired_counts(
    df: DataFrame, names: list[str], texts: list[str], exact: bool, sketch: bool,
) -> dict[str, dict[str, int]]:
    pairs = value_pairs(df, names)
    if exact:
        pairs = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    else:
        pairs = pairs.withColumn("n", F.lit(1).cast("bigint"))
    value, n, of_text = F.col("value"), F.col("n"), F.col("column_name").isin(*texts)
    tests = {key: of_text & test for key, test in _text_tests(value).items()} if texts else {}
    # Written for (column, value) rows, the tests compile once for all columns.
    aggregates = {
        "rows": F.sum("n"), "nulls": F.sum(F.when(value.isNull(), n)),
        **{key: F.sum(F.when(test, n)) for key, test in tests.items()},
    }
    if exact:
        aggregates |= {"distinct": F.count("value"), "distinct_filled": F.count_if(F.trim(value) != "")}
    elif sketch:
        aggregates |= {"distinct": F.approx_count_distinct("value"), "distinct_filled": F.approx_count_distinct(
            F.when(F.trim(value) != "", value))}
    per_column = pairs.groupBy("column_name").agg(*[a.alias(key) for key, a in aggregates.items()])
    return {r["column_name"]: r.asDict() for r in per_column.collect()}


def _value_text(df: DataFrame, name: str) -> Column:
    return F.when(~is_null(df, name), col(name).cast("string"))


def value_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value) rows, values as text, nulls kept."""
    names = df.columns if columns is None else columns
    text = df.select(*[_value_text(df, name).alias(name) for name in names])
    return text.unpivot([], [col(name) for name in names], "column_name", "value")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count per column and non-null value. Counts are summed before the shuffle, so a value that
    fills a third of all rows arrives as one row per task."""
    return (
        value_pairs(df, columns).where(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    )


def top_values(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent values per column, ties by value. The row_number filter lets Spark keep
    only ``limit`` rows per column in each task before the shuffle."""
    rank = F.row_number().over(
        Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit)


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A result the driver holds: one row per column of the analysed table."""
    return spark.createDataFrame(rows, schema)


def per_column(df: DataFrame, columns: list[str], outputs: dict) -> DataFrame:
    """One aggregate for all columns, then one row per column. ``outputs`` maps an output name to
    a function from (column value, column name) to an aggregate."""
    values = df.select(*[number(df, name).alias(f"c{i}") for i, name in enumerate(columns)])
    row = values.agg(*[
        make(F.col(f"c{i}"), name).alias(f"{i}_{out}")
        for i, name in enumerate(columns) for out, make in outputs.items()
    ])
    items = F.array(*[
        F.struct(F.lit(name).alias("column_name"), *[F.col(f"{i}_{out}").alias(out) for out in outputs])
        for i, name in enumerate(columns)
    ])
    return row.select(F.inline(items))


# --- profile tables ---------------------------------------------------------------------------


def column_profile(df: DataFrame, roles: dict[str, str], stats: list[ColumnStats]) -> DataFrame:
    rows = [(
        s.name, s.type, s.blanks, half_up_value(s.blanks / max(1, s.rows) * 100, 2), s.distinct,
        half_up_value(s.distinct / max(1, s.rows), 4), s.distinct <= 1, s.identifier_like,
        s.cardinality, roles.get(s.name, "unknown"),
    ) for s in stats]
    return local_frame(df.sparkSession, rows, (
        "column_name string, dtype string, missing bigint, missing_pct double, distinct_values bigint, "
        "unique_ratio double, is_constant boolean, is_identifier_like boolean, cardinality string, role string"))


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = numeric_columns(df) if columns is None else columns
    medians = exact_quantiles(df, names, [0.5])
    return per_column(df, names, {
        "min": lambda c, _: half_up(F.min(c), 4),
        "max": lambda c, _: half_up(F.max(c), 4),
        "mean": lambda c, _: half_up(F.avg(c), 4),
        "median": lambda c, name: half_up(F.lit(medians[name][0]).cast("double"), 4),
        "std": lambda c, _: half_up(
            F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c)), 4),
    })


def bias_corrected_skew(value: Column) -> Column:
    """Sample skewness; null under three values, 0 for a constant column."""
    n = F.count(value).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0))
    return F.when(n > 2, F.coalesce(F.nanvl(F.skewness(value), F.lit(0.0)), F.lit(0.0)) * factor)


def skewness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = numeric_columns(df) if columns is None else columns
    raw = per_column(df, names, {"skew": lambda c, _: bias_corrected_skew(c)})
    skew = F.col("skew")
    return raw.select(
        "column_name", half_up(skew, 4).alias("skewness"),
        F.when(skew.isNull(), "unknown").when(F.abs(skew) < 0.5, "approximately symmetric")
        .when(skew > 0, "right-skewed").otherwise("left-skewed").alias("label"),
    )


def cardinality(df: DataFrame, stats: list[ColumnStats] | None = None) -> DataFrame:
    rows = []
    for s in stats or column_stats(df):
        distinct = s.distinct_filled if s.kind == "text" else s.distinct
        rows.append((s.name, distinct, half_up_value(distinct / max(1, s.rows), 4),
                     half_up_value(s.distinct / max(1, s.rows) * 100, 4), s.cardinality))
    return local_frame(df.sparkSession, rows, (
        "column_name string, unique_count bigint, ratio double, unique_pct double, label string"))


def categorical_top_values(df: DataFrame, columns: list[str], limit: int = 10) -> DataFrame:
    filled = value_counts(df, columns).where(F.trim("value") != "")
    return top_values(filled, limit).select("column_name", "value", "count")


def suspicious_columns(df: DataFrame, stats: list[ColumnStats]) -> DataFrame:
    """Text columns that are constant or identifiers, of high cardinality, or 30% missing."""
    rows = []
    for s in (s for s in stats if s.kind in ("text", "bool", "other") and not s.date_like):
        if s.distinct_filled <= 1 or s.identifier_like:
            rows.append((s.name, "identifier_like_or_constant", s.distinct_filled))
        elif s.cardinality in ("high", "very_high"):
            rows.append((s.name, "high_cardinality", s.distinct_filled))
        if s.blanks and s.blanks / max(1, s.rows) >= 0.3:
            rows.append((s.name, "high_missingness", s.blanks))
    return local_frame(df.sparkSession, rows, "column_name string, reason string, observed bigint")


def unique_values(df: DataFrame, limit: int = 5) -> DataFrame:
    """Distinct count and the most common values per column; nulls are listed as ``Missing``."""
    named = (
        value_pairs(df).groupBy("column_name", F.coalesce("value", F.lit("Missing")).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"), F.count("value").alias("_real"))
    )
    rank = F.row_number().over(
        Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value")))
    # Aggregates see each value once; the list holds at most `limit` entries per column.
    leaders = (
        named.withColumn("rank", rank).where(F.col("rank") <= limit)
        .groupBy("column_name").agg(F.sort_array(F.collect_list(
            F.struct("rank", F.concat("value", F.lit(" ("), F.col("count").cast("string"), F.lit(")"))
                     .alias("text")))).alias("_top"))
    )
    distinct = named.groupBy("column_name").agg(F.count_if(F.col("_real") > 0).alias("unique_values"))
    return distinct.join(leaders, "column_name").select(
        "column_name", "unique_values", F.array_join("_top.text", ", ").alias("top_values"))


def schema_profile(df: DataFrame, stats: list[ColumnStats] | None = None) -> DataFrame:
    """Type, missing and distinct counts, sample values, numeric range and date hint per column.

    Samples are the smallest distinct values: the first rows of a distributed table are not stable.
    """
    stats = stats or column_stats(df)
    pairs = value_counts(df)
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.asc("value")))
    samples = (
        pairs.withColumn("rank", rank).where(F.col("rank") <= 5)
        .groupBy("column_name").agg(F.array_join(F.sort_array(F.collect_list(
            F.substring("value", 1, 120))), " | ").alias("sample_values"))
    )
    # Numbers in 60% of the values (at least two) earn a numeric range.
    ranged = [s.name for s in stats if s.numeric_values >= max(2, int(s.filled * 0.6))]
    names = [s.name for s in stats]
    numbers = per_column(df, names, {
        "min": lambda c, n: half_up(F.min(c), 6) if n in ranged else F.lit(None).cast("double"),
        "max": lambda c, n: half_up(F.max(c), 6) if n in ranged else F.lit(None).cast("double"),
        "mean": lambda c, n: half_up(F.avg(c), 6) if n in ranged else F.lit(None).cast("double"),
        "sum": lambda c, n: half_up(F.sum(c.cast("decimal(28,6)")), 6) if n in ranged
        else F.lit(None).cast("double"),
    })
    facts = local_frame(df.sparkSession, [
        (s.name, s.type, s.nulls, s.distinct, s.date_hint) for s in stats
    ], "column_name string, dtype string, missing_count bigint, unique_count bigint, looks_like_date boolean")
    return facts.join(numbers, "column_name").join(samples, "column_name", "left")
