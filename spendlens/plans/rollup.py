"""Stored rollup: mergeable states of the campaigns at the slicers' grain, for KPIs and trends without the facts.

Pass ``over=STATES`` to an operator to have it read states instead of rows: K1,
K4, K5, K7 to K10 and T1 to T5, at any grain and slice made of ``GRAIN``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import child_names

#: The finest grain; ``date`` is the first day of the month.
GRAIN = ("date", "year", "month_number", "quarter", "year_quarter", "platform", "product", "ad_format", "fatigue_status")
MEASURED = (
    "spend", "gross_revenue", "net_revenue", "purchases", "impressions", "reach", "clicks", "frequency", "fatigue_score",
    "hook_rate", "hold_rate_3s", "completion_rate", "cpm", "ctr", "cvr", "cpa", "roas", "breakeven_roas",
)


def states(facts: DataFrame, measured: Sequence[str] = MEASURED) -> DataFrame:
    """One row per cell of ``GRAIN``: ``rows``, and sum, filled values, minimum and maximum of each measure.

    Sums are exact decimals or longs, so figures from states equal those from
    rows. A NULL in the grain is a cell like others.
    """
    monthly = facts.withColumn("date", F.trunc("date", "month"))
    figures = [F.count("*").alias("rows")]
    for c in measured:
        figures += [F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_filled"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return monthly.groupBy(*GRAIN).agg(*figures)


def merge(rollup: DataFrame, by: Sequence[str] = GRAIN) -> DataFrame:
    """States at the coarser grain ``by``, or of several rollups put together, without the facts."""
    kinds = {f.name: f.dataType for f in rollup.schema}
    figures = [F.sum("rows").alias("rows")]
    for name in rollup.columns:
        if name.endswith("_sum") or name.endswith("_filled"):
            figures.append(F.sum(name).cast(kinds[name]).alias(name))
        elif name.endswith("_min") or name.endswith("_max"):
            figures.append((F.min if name.endswith("_min") else F.max)(name).alias(name))
    return rollup.groupBy(*by).agg(*figures)


def add(facts: DataFrame, path: str) -> DataFrame:
    """Add the states of new ``facts`` to the rollup at ``path`` and return the whole rollup.

    What is stored is left alone: a cell may then have a row in several parts,
    which every reader adds up. ``compact`` puts them together.
    """
    part = len(child_names(facts.sparkSession, path))
    states(facts).write.mode("errorifexists").parquet(f"{path}/part={part}")
    return read(facts.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def compact(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Write the rollup at ``path`` to ``to`` with one row per cell."""
    merge(read(spark, path)).write.mode("errorifexists").parquet(f"{to}/part=0")
    return read(spark, to)
