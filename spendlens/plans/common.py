"""Shared pieces of the questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import mean_to, sum_to

CREATIVE_GRAIN = ("ad_id", "platform", "product", "hook_type")


def campaigns(name: str) -> Column:
    return F.count("*").alias(name)


def spend_total(name: str = "total_spend") -> Column:
    return sum_to("spend").alias(name)


def roas_pair() -> list[Column]:
    """Unweighted means of ROAS and of breakeven ROAS."""
    return [mean_to("roas", 2).alias("avg_roas"), mean_to("breakeven_roas", 2).alias("avg_breakeven")]


def highest_first(name: str) -> Column:
    """Descending with NULL first, as the source database sorts."""
    return F.desc_nulls_first(name)


def lowest_first(name: str) -> Column:
    """Ascending with NULL last."""
    return F.asc_nulls_last(name)


def with_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the grand total of ``value``, taken over the rows of the aggregate ``df``.

    For aggregates of a fixed grain (platforms, products, labels): all their
    rows, not their input, go through one task.
    """
    return df.withColumn(name, F.sum(value).over(Window.partitionBy()))


def change_from_previous(
    df: DataFrame, value: str, name: str, within: Sequence[str], order: Sequence[str], digits: int = 2
) -> DataFrame:
    """Difference to the row before. For aggregated rows only: one task takes a whole ``within`` group."""
    previous = F.lag(value).over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn(name, F.round(F.col(value) - previous, digits))


def change_along_chunks(
    df: DataFrame, value: str, name: str, within: Sequence[str], chunk: Sequence[str], last: str, digits: int = 2
) -> DataFrame:
    """Difference to the row before in the order ``(*chunk, last)`` inside ``within``.

    Same result as one window over ``within``, for groups too long for one task:
    rows are lagged inside each chunk, and the first row of a chunk takes the
    last value of the chunk before it. Only one row per chunk goes through the
    window over the whole group. The last rows of the chunks keep all columns, so
    that both sides read one shuffle of the same aggregate.
    """
    inside = Window.partitionBy(*within, *chunk).orderBy(last)
    lagged = df.withColumns({"_inside": F.lag(value).over(inside), "_place": F.row_number().over(inside)})
    ends = df.groupBy(*within, *chunk).agg(F.max_by(F.struct(*df.columns), last).alias("_end"))
    across = Window.partitionBy(*within).orderBy(*chunk)
    ends = ends.withColumn("_before", F.lag(F.col("_end").getField(value)).over(across)).drop("_end")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*within, *chunk)]
    joined = lagged.alias("l").join(ends.alias("e"), same, "left")
    previous = F.when(F.col("_place") == 1, F.col("_before")).otherwise(F.col("_inside"))
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns],
        F.round(F.col(f"l.{value}") - previous, digits).alias(name),
    )
