"""Amounts of money that keep every finite value and are summed exactly wherever that is possible.

An amount below 10^14 is a decimal with four digits, so its sums do not depend on the order of tasks.
A larger one does not fit such a decimal and is carried beside it as a double. Both are summed apart and
come together when a total is shown, compared or divided; a total without large amounts stays a decimal.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.coerce import MONEY, currency_number, finite, money, number
from prismtab.functions.rounding import money_round

REST = "_rest"


def zero() -> Column:
    return F.lit(0).cast("decimal(18,4)")


@dataclass(frozen=True)
class Amount:
    """``exact`` is a decimal or null, ``rest`` a double or null; both null is no amount."""

    exact: Column
    rest: Column

    @staticmethod
    def of(name: str) -> Amount:
        """The amount held by the columns that ``named`` has made."""
        return Amount(F.col(name), F.col(name + REST))

    def named(self, name: str) -> list[Column]:
        return [self.exact.alias(name), self.rest.alias(name + REST)]

    def sum(self) -> Amount:
        return Amount(F.sum(self.exact), F.sum(self.rest))

    def where(self, condition: Column) -> Amount:
        return Amount(F.when(condition, self.exact), F.when(condition, self.rest))

    def or_zero(self) -> Amount:
        return Amount(F.coalesce(self.exact, zero()), self.rest)

    def __neg__(self) -> Amount:
        return Amount(-self.exact, -self.rest)

    def __sub__(self, other: Amount) -> Amount:
        """Null where one side is no amount."""
        both = self.known() & other.known()
        large = self.rest.isNotNull() | other.rest.isNotNull()
        nought = F.lit(0.0)
        return Amount(F.when(both, F.coalesce(self.exact, zero()) - F.coalesce(other.exact, zero())),
                      F.when(both & large, F.coalesce(self.rest, nought) - F.coalesce(other.rest, nought)))

    def otherwise(self, other: Amount) -> Amount:
        """The other amount where this is none."""
        return Amount(F.when(self.known(), self.exact).otherwise(other.exact), F.when(self.known(), self.rest).otherwise(other.rest))

    def known(self) -> Column:
        return self.exact.isNotNull() | self.rest.isNotNull()

    def nonzero(self) -> Column:
        return F.when(self.rest.isNull(), self.exact != 0).otherwise(self.double() != 0)

    def double(self) -> Column:
        exact = self.exact.cast("double")
        return F.when(self.rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + self.rest)

    def shown(self) -> Column:
        """With two digits, as a double."""
        return F.when(self.rest.isNull(), money_round(self.exact)).otherwise(F.round(self.double(), 2))

    def largest_first(self) -> list[Column]:
        return [self.double().desc(), self.exact.desc()]

    def smallest_first(self) -> list[Column]:
        return [self.double().asc(), self.exact.asc()]

    def rank_key(self) -> Column:
        """What orders totals as ``smallest_first`` does, as one value."""
        return F.struct(self.double(), self.exact)


def amount(df: DataFrame, name: str) -> Amount:
    """The column as an amount; text that is no number, NaN and the infinities are none."""
    exact = money(df, name)
    return Amount(exact, F.when(exact.isNull(), finite(number(df, name))))


def product(left: Amount, right: Amount) -> Amount:
    """Missing sides count as 0; a product with a large side, or too long for a decimal, is a double."""
    exact = F.try_multiply(F.coalesce(left.exact, zero()), F.coalesce(right.exact, zero()))
    large = left.rest.isNotNull() | right.rest.isNotNull()
    return Amount(F.when(~large, exact), F.when(large, finite(left.or_zero().double() * right.or_zero().double())))


def currency_amount(value: Column) -> Amount:
    """The amount in text with currency marks and thousands commas."""
    text = currency_number(value)
    exact = text.try_cast(MONEY)
    return Amount(exact, F.when(exact.isNull(), finite(text.cast("double"))))
