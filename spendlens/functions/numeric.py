"""Rounding, safe ratios and exact means.

Money and rates are decimals. Means stay decimals to twenty places, so a mean
that equals a threshold compares as equal; a mean taken as a double may miss it
(0.54 / 3 > 0.18). Other ratios are doubles and come back to decimals in ``rnd``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDING_TYPE = "decimal(38,10)"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def exact(value: float | int | str) -> Column:
    """Literal decimal with exactly the digits written."""
    return F.lit(Decimal(str(value)))


def rnd(value: Column | str, digits: int) -> Column:
    """Round half away from zero to ``digits`` places; the result is a decimal."""
    return F.round(as_column(value).cast(ROUNDING_TYPE), digits)


def sdiv(numerator: Column | str, denominator: Column | str) -> Column:
    """Fractional ratio; NULL where the denominator is zero or NULL."""
    top = as_column(numerator).cast("double")
    bottom = as_column(denominator).cast("double")
    return top / F.nullif(bottom, F.lit(0.0))


def pct(numerator: Column | str, denominator: Column | str, digits: int = 2) -> Column:
    return rnd(sdiv(numerator, denominator) * 100, digits)


def mean(value: Column | str) -> Column:
    """Mean of the non-NULL values as a decimal with twenty places, from an exact sum.

    ``avg`` over a decimal keeps only four digits beyond the input scale, which
    rounds once before ``rnd`` rounds again.
    """
    column = as_column(value)
    return _quotient(F.sum(column), F.count(column))


def _quotient(total: Column, filled: Column) -> Column:
    return total.cast("decimal(28,10)") / F.nullif(filled, F.lit(0)).cast("decimal(18,0)")


def money_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Ratio of two amounts with cents as a decimal with eighteen places; NULL for a zero denominator."""
    top = as_column(numerator).cast("decimal(20,2)")
    bottom = as_column(denominator).cast("decimal(20,2)")
    return top / F.nullif(bottom, F.lit(0).cast("decimal(20,2)"))


def mean_to(value: Column | str, digits: int) -> Column:
    return rnd(mean(value), digits)


def sum_to(value: Column | str, digits: int = 2) -> Column:
    """Sum of decimals, rounded without leaving the decimal type."""
    return F.round(F.sum(as_column(value)), digits)


def sum_where(condition: Column, value: Column | str) -> Column:
    """Sum over the rows where ``condition`` holds; the others count as zero."""
    return F.sum(F.when(condition, as_column(value)).otherwise(F.lit(0)))


@dataclass(frozen=True)
class Figures:
    """How the rows, sums and filled values of a group are taken; means and rounded sums follow from them."""

    rows: Callable[[], Column]
    total: Callable[[str], Column]
    filled: Callable[[str], Column]

    def mean(self, name: str) -> Column:
        return _quotient(self.total(name), self.filled(name))

    def mean_to(self, name: str, digits: int) -> Column:
        return rnd(self.mean(name), digits)

    def sum_to(self, name: str, digits: int = 2) -> Column:
        return F.round(self.total(name), digits)


#: Over campaign rows, and over stored states of them (``rows``, ``<name>_sum``, ``<name>_filled``).
ROWS = Figures(lambda: F.count("*"), F.sum, F.count)
STATES = Figures(lambda: F.sum("rows"), lambda name: F.sum(f"{name}_sum"), lambda name: F.sum(f"{name}_filled"))
