"""Trends over months, quarters and years. Windows run on aggregated rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ROWS, Figures, rnd, sdiv
from .kpis import MEASURES


def _change_columns(previous: Column, digits: int) -> list[Column]:
    value = F.col("value")
    return [
        previous.alias("previous_value"),
        F.round(value - previous, digits).alias("change"),
        rnd(sdiv(value - previous, previous) * 100, 2).alias("change_pct"),
    ]


def mom(df: DataFrame, measure: str, by: Sequence[str] = (), over: Figures = ROWS) -> DataFrame:
    """T1. A measure month by month with the change to the month before.

    Every month between a group's first and last has a row. A month without
    campaigns has no value, and the month after it no change; neither has one
    whose predecessor is zero a percentage.
    """
    month = F.trunc("date", "month").alias("month")
    per_month = df.groupBy(*by, month).agg(MEASURES[measure](over).alias("value"))
    order = Window.partitionBy(*by).orderBy("month")
    following = F.coalesce(F.lead("month").over(order), F.add_months("month", 1))
    spine = per_month.withColumn("_until", F.add_months(following, -1)).select(
        *by,
        F.col("month").alias("_filled"),
        "value",
        F.explode(F.sequence("month", "_until", F.expr("interval 1 month"))).alias("month"),
    )
    dense = spine.withColumn("value", F.when(F.col("month") == F.col("_filled"), F.col("value")))
    return dense.select(
        *by, F.date_format("month", "yyyy-MM").alias("year_month"), "value", *_change_columns(F.lag("value").over(order), 4)
    ).orderBy(*by, "year_month")


def yoy(df: DataFrame, measure: str, by: Sequence[str] = (), over: Figures = ROWS) -> DataFrame:
    """T2. A measure year by year with the change to the year before, if there is one."""
    per_year = df.groupBy(*by, "year").agg(MEASURES[measure](over).alias("value"))
    order = Window.partitionBy(*by).orderBy("year")
    adjacent = F.lag("year").over(order) == F.col("year") - 1
    previous = F.when(adjacent, F.lag("value").over(order))
    return per_year.select(*by, "year", "value", *_change_columns(previous, 4)).orderBy(*by, "year")


def _quarters(df: DataFrame, by: Sequence[str], over: Figures) -> DataFrame:
    return df.groupBy(*by, "year", "quarter", "year_quarter").agg(
        over.mean_to("roas", 2).alias("avg_roas"),
        over.mean_to("breakeven_roas", 2).alias("avg_breakeven"),
        rnd(over.mean("roas") - over.mean("breakeven_roas"), 2).alias("gap"),
        (over.mean("roas") < over.mean("breakeven_roas")).alias("below"),
    )


def quarter_trend(df: DataFrame, by: Sequence[str] = ("platform",), over: Figures = ROWS) -> DataFrame:
    """T3. Quarterly ROAS against breakeven, with the step to the quarter before."""
    previous = F.lag("avg_roas").over(Window.partitionBy(*by).orderBy("year", "quarter"))
    return (
        _quarters(df, by, over)
        .select(
            *by,
            "year_quarter",
            "avg_roas",
            "avg_breakeven",
            "gap",
            (F.col("avg_roas") - previous).alias("roas_change"),
        )
        .orderBy(*by, "year_quarter")
    )


def decline_streak(df: DataFrame, by: Sequence[str] = ("platform",), over: Figures = ROWS) -> DataFrame:
    """T4. Longest run of quarters that each fell below the one before.

    ``declines`` counts the falls and ``quarters`` the quarters of the run, its
    start included. The earliest of equally long runs is given; a group that
    never declines has zero falls and no run.
    """
    order = Window.partitionBy(*by).orderBy("year", "quarter")
    fell = F.coalesce(F.col("avg_roas") < F.lag("avg_roas").over(order), F.lit(False))
    marked = _quarters(df, by, over).withColumn("_fell", fell)
    runs = marked.withColumn("_run", F.sum(F.when(F.col("_fell"), 0).otherwise(1)).over(order))
    lengths = runs.groupBy(*by, "_run").agg(
        F.count_if("_fell").alias("declines"),
        F.min("year_quarter").alias("from_quarter"),
        F.max("year_quarter").alias("to_quarter"),
    )
    # Longest first; among equals the lowest run number, which is the earliest.
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("declines"), "_run"))
    found = F.col("declines") > 0
    return (
        lengths.withColumn("_place", place)
        .filter(F.col("_place") == 1)
        .select(
            *by,
            "declines",
            F.when(found, F.col("declines") + 1).otherwise(F.lit(0)).cast("bigint").alias("quarters"),
            F.when(found, F.col("from_quarter")).alias("from_quarter"),
            F.when(found, F.col("to_quarter")).alias("to_quarter"),
        )
        .orderBy(*by)
    )


def breakeven_crossing(df: DataFrame, by: Sequence[str] = ("platform",), over: Figures = ROWS) -> DataFrame:
    """T5. First quarter with mean ROAS below mean breakeven; NULL if it never is."""
    under = F.when(F.col("below"), F.col("year_quarter"))
    return (
        _quarters(df, by, over)
        .groupBy(*by)
        .agg(
            F.min(under).alias("first_quarter_below"),
            F.count_if("below").alias("quarters_below"),
            F.count("*").alias("quarters"),
        )
        .orderBy(*by)
    )
