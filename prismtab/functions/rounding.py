"""Rounding half-up on decimals, so a tie never depends on binary representation."""
from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """A double rounded half-up; numbers too long for the decimal are rounded as doubles."""
    exact = F.round(value.try_cast("decimal(38,12)"), digits).cast("double")
    return F.coalesce(exact, F.round(value.cast("double"), digits))


def money_round(value: Column) -> Column:
    """An exact decimal amount as a double with two digits."""
    return F.round(value, 2).cast("double")


def json_safe(value: Column) -> Column:
    """Null for NaN and the infinities, otherwise six digits."""
    plain = F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)
    return half_up(plain, 6)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` rounded; 0 when the whole is 0."""
    ratio = F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0))
    return half_up(ratio, digits)


def half_up_value(value: float | None, digits: int) -> float | None:
    """The same rule for a plain number, used on the few statistics the driver holds."""
    if value is None:
        return None
    step = Decimal(1).scaleb(-digits)
    return float(Decimal(repr(float(value))).quantize(step, rounding=ROUND_HALF_UP))
