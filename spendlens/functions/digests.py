"""Digests of sets of rows, independent of their order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _null_bits(columns: Sequence[str]) -> list[Column]:
    """One bit a column that tells whether it is NULL, 63 of them in a long."""
    bit = lambda at, name: F.when(F.col(f"`{name}`").isNull(), F.lit(1 << at)).otherwise(F.lit(0)).cast("long")
    some = [columns[i : i + 63] for i in range(0, len(columns), 63)]
    return [reduce(Column.bitwiseOR, [bit(at, name) for at, name in enumerate(part)]) for part in some]


def row_hash(columns: Sequence[str], seed: int, *more: Column) -> Column:
    """A hash of 64 bits over the values of a row; the NULL bits tell a NULL from a value that moved to the next column."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns], *_null_bits(columns), *more)


def halves(hashed: str) -> tuple[Column, Column]:
    """Two numbers of 32 bits, both signed: their sums stay in a long for four billion equal rows, and far more of unequal ones."""
    return F.shiftright(hashed, 32), F.col(hashed).bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)


def digests(df: DataFrame, by: Sequence[Column], columns: Sequence[str], *more: Column) -> DataFrame:
    """One row per value of ``by``: ``rows`` and sums ``digest_a`` and ``digest_b`` of two 64-bit hashes of each row.

    With the number of rows they stand for the rows, whatever their order and
    their split over tasks. The hashes are summed by halves, as longs.
    """
    hashed = df.select(*by, row_hash(columns, 0, *more).alias("_a"), row_hash(columns, 1, *more).alias("_b"))

    def summed(name: str) -> Column:
        high, low = (F.sum(half).cast("decimal(20,0)") for half in halves(name))
        return (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(38,0)")

    keys = [c for c in hashed.columns if c not in ("_a", "_b")]
    return hashed.groupBy(*keys).agg(F.count("*").alias("rows"), summed("_a").alias("digest_a"), summed("_b").alias("digest_b"))
