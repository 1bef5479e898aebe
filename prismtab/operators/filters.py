"""Previews and value filters."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.coerce import (
    NUMERIC_TEXT, col, dtype, is_date, is_number, number, timestamp,
)
from prismtab.functions.rounding import json_safe

MAX_ROWS = 20


def clamp_limit(requested: int | None, default: int = 10, most: int = 25) -> int:
    """A requested number of rows, kept between 1 and ``most``."""
    return default if requested is None else max(1, min(requested, most))


def preview(df: DataFrame, *keys: str, rows: int = 10) -> DataFrame:
    """The first rows by key: a distributed table has no first row of its own."""
    return df.orderBy(*[F.asc(k) for k in keys]).limit(rows)


def display_safe(df: DataFrame) -> DataFrame:
    """Floating columns with NaN and the infinities as null and six digits."""
    floating = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({name: json_safe(col(name).cast("double")) for name in floating})


def _matches(df: DataFrame, column: str, value: str, literal: bool) -> Column:
    if is_number(dtype(df, column)) and re.match(NUMERIC_TEXT, value):
        return col(column) == F.lit(float(value))
    text = col(column).cast("string")
    if literal:
        return F.contains(F.lower(text), F.lit(value.lower()))
    return text.rlike("(?i)" + value)


def filter_rows(df: DataFrame, column: str, value: str, literal: bool = True) -> DataFrame:
    """Rows equal to a number, or whose text contains the value in any case.

    ``literal=False`` reads the value as a regular expression."""
    return df.where(_matches(df, column, value, literal))


def filter_shown(df: DataFrame, column: str, value: str, *keys: str, literal: bool = True) -> DataFrame:
    """The first 20 matching rows by key, as a report shows them."""
    return preview(filter_rows(df, column, value, literal), *keys, rows=MAX_ROWS)


def filter_counts(df: DataFrame, column: str, value: str, literal: bool = True) -> DataFrame:
    """One row: matching rows and all rows."""
    return df.agg(F.count_if(_matches(df, column, value, literal)).alias("matching_rows"),
                  F.count(F.lit(1)).alias("total_rows"))


def filter_value_counts(df: DataFrame, column: str, limit: int = MAX_ROWS) -> DataFrame:
    """The most common values of a column, for when no value was given."""
    return (
        df.where(col(column).isNotNull()).groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("value")).limit(limit)
    )


def coerce_columns(df: DataFrame, numbers: list[str] = (), dates: list[str] = ()) -> DataFrame:
    """Named columns as numbers and timestamps; what does not parse becomes null."""
    changes = {name: number(df, name) for name in numbers if not is_number(dtype(df, name))}
    changes |= {name: timestamp(df, name) for name in dates if not is_date(dtype(df, name))}
    return df.withColumns(changes) if changes else df


def since(df: DataFrame, date: str, day) -> DataFrame:
    """Rows from a day on. Dates of a date type are compared in their own type, so the filter
    reaches the file scan."""
    kind = dtype(df, date)
    if is_date(kind):
        return df.where(col(date) >= F.lit(day).cast(kind))
    return df.where(timestamp(df, date) >= F.lit(day).cast("timestamp"))


def require(df: DataFrame, **roles: str | None) -> None:
    """Stop early with a clear message when a needed column is missing."""
    missing = [role for role, column in roles.items() if not column or column not in df.columns]
    if missing:
        raise ValueError("missing columns for: " + ", ".join(missing))
