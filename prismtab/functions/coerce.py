"""Safe conversions from untrusted text to numbers, money and timestamps.

Spark 4 raises on a bad plain cast, so text is matched against a pattern first or goes through a
``try_`` function. Bad text becomes null, never an error.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_TEXT = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
RANGE_TEXT = r"(?i)\d+\s*[-–]\s*\d+|\$|m\b|million|k\b|employees?"
TIME_PART = "[ H:mm[:ss]]"
MONTH_FIRST, DAY_FIRST = (
    [f"{day}{TIME_PART}" for day in ("yyyy/M/d", *days)] for days in (("M/d/yyyy", "M-d-yyyy", "M/d/yy", "M-d-yy"), ("d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy")))

# Exact sums need decimals: their result does not depend on the order of tasks. 18 digits keep the
# compact form; amounts of 10^14 and more do not fit and are kept as doubles (functions.amounts).
MONEY = T.DecimalType(18, 4)
MEASURE = T.DecimalType(38, 12)


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def is_date(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def col(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def finite(value: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def numeric_text(value: Column) -> Column:
    return value.rlike(NUMERIC_TEXT)


def number(df: DataFrame, name: str) -> Column:
    """The column as a finite double; text that is no number becomes null."""
    kind, value = dtype(df, name), col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(value.cast("double"))
    if is_number(kind) or isinstance(kind, T.BooleanType):
        return value.cast("double")
    if is_text(kind):
        return F.when(numeric_text(value), F.trim(value).cast("double"))
    return F.lit(None).cast("double")


def money(df: DataFrame, name: str) -> Column:
    """The column as an exact amount of money with four digits; text that is no number, and amounts of
    10^14 and more (see ``functions.amounts``), are null, never an error."""
    kind, value = dtype(df, name), col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(value).try_cast(MONEY)
    if isinstance(kind, T.DecimalType):
        # Already summed decimals are wider; keep their integer digits.
        return value if kind.scale <= 4 and kind.precision >= 18 else value.try_cast(MONEY)
    if is_number(kind):
        return value.try_cast(MONEY)
    if is_text(kind):
        return F.when(numeric_text(value), F.trim(value).try_cast(MONEY))
    return F.lit(None).cast(MONEY)


def measure(df: DataFrame, name: str) -> Column:
    """The column as a decimal with twelve digits behind the point, so that sums are exact in any order and
    small values stay; what is no number, or has more than 26 digits before the point, becomes null."""
    kind, value = dtype(df, name), col(name)
    if isinstance(kind, T.DecimalType):
        return value
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(value).try_cast(MEASURE)
    if is_number(kind):
        return value.try_cast(MEASURE)
    if is_text(kind):
        return F.when(numeric_text(value), F.trim(value).try_cast(MEASURE))
    return F.lit(None).cast(MEASURE)


def mean(df: DataFrame, name: str, alias: str) -> Column:
    """Average of a column selected under an alias; exact sums where the column is a decimal."""
    if isinstance(dtype(df, name), T.DecimalType):
        return F.try_divide(F.sum(alias).cast("double"), F.count(alias))
    return F.avg(alias)


def plain_number(df: DataFrame, name: str) -> Column:
    """A decimal as it is, everything else as a double."""
    return col(name) if isinstance(dtype(df, name), T.DecimalType) else number(df, name)


def currency_number(value: Column) -> Column:
    """The number in text such as ``Rs 1,234.50``, still as text; null where it is none."""
    bare = F.trim(F.regexp_replace(value, "Rs|rs|,", ""))
    return F.when(numeric_text(bare), bare)


def timestamp(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; text no known format fits becomes null. All text of a column is read in one
    order of day and month: the one in which more of its values are dates, month first if both fit. The vote
    is a subquery over the column, counted within each task."""
    kind, value = dtype(df, name), col(name)
    if is_date(kind):
        return value.cast("timestamp")
    if is_text(kind):
        days, months = (F.count(ordered_timestamp(F.col("_text"), order)) for order in (DAY_FIRST, MONTH_FIRST))
        day_first = df.select(value.alias("_text")).agg((days > months).alias("day_first")).scalar()
        return F.when(day_first, ordered_timestamp(value, DAY_FIRST)).otherwise(ordered_timestamp(value, MONTH_FIRST))
    return F.lit(None).cast("timestamp")


def ordered_timestamp(value: Column, order: list[str]) -> Column:
    """Text as a timestamp, day and month in the given order; ISO dates need none. Years of two digits lie
    between 1969 and 2068."""
    text = F.trim(value)
    full, short = ([p for p in order if ("yyyy" in p) is whole] for whole in (True, False))
    parsed = F.coalesce(text.try_cast("timestamp"), *(F.try_to_timestamp(text, F.lit(pattern)) for pattern in full))
    late = F.coalesce(*(F.try_to_timestamp(text, F.lit(pattern)) for pattern in short))
    century = F.when(F.year(late) >= 2069, late - F.make_ym_interval(F.lit(100))).otherwise(late)
    return F.when(value.rlike(DATE_TEXT), F.coalesce(parsed, century))


def is_blank(df: DataFrame, name: str) -> Column:
    """Null, NaN, or text of nothing but blanks."""
    value = col(name)
    if is_text(dtype(df, name)):
        return value.isNull() | (F.trim(value) == "")
    return is_null(df, name)


def is_null(df: DataFrame, name: str) -> Column:
    value = col(name)
    if isinstance(dtype(df, name), (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def label(df: DataFrame, name: str, missing: str = "Unknown") -> Column:
    """A grouping label: text form with nulls named."""
    return F.coalesce(col(name).cast("string"), F.lit(missing))


def upper_trim(value: Column) -> Column:
    return F.upper(F.trim(value.cast("string")))
