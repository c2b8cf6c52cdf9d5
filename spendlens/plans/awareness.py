"""Awareness: reach, frequency and whether spend follows results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ladders import Ladder
from ..functions.numeric import mean_to, pct, rnd, sdiv
from ..labels import SPEND_VERDICTS
from .common import campaigns, highest_first, roas_pair, spend_total, with_total


def avg_roas_by_platform(facts: DataFrame) -> DataFrame:
    """Q1. Mean ROAS per platform."""
    return facts.groupBy("platform").agg(mean_to("roas", 2).alias("avg_roas"))


def reach_by_platform(facts: DataFrame) -> DataFrame:
    """Q2. Volume, frequency, fatigue and the price of one reached person."""
    return (
        facts.groupBy("platform")
        .agg(
            campaigns("total_campaigns"),
            F.sum("impressions").alias("total_impressions"),
            F.sum("reach").alias("total_reach"),
            mean_to("frequency", 2).alias("avg_frequency"),
            mean_to("fatigue_score", 2).alias("avg_fatigue_score"),
            spend_total(),
            rnd(sdiv(F.sum("spend"), F.sum("reach")), 4).alias("cost_per_unique_reach"),
        )
        .orderBy(highest_first("total_impressions"), "platform")
    )


def spend_verdict(facts: DataFrame, labels=SPEND_VERDICTS, flag_nulls: bool = False) -> DataFrame:
    """Q3. Share of the grand total and whether mean ROAS clears mean breakeven (both rounded)."""
    per_cell = facts.groupBy("platform", "product").agg(spend_total(), *roas_pair())
    clears = F.col("avg_roas") >= F.col("avg_breakeven")
    verdict = Ladder(((clears, labels[0]),), labels[1], (F.col("avg_roas"), F.col("avg_breakeven")))
    return (
        with_total(per_cell, "total_spend", "_all_spend")
        .select(
            "platform",
            "product",
            "total_spend",
            pct("total_spend", "_all_spend").alias("spend_share_pct"),
            "avg_roas",
            "avg_breakeven",
            F.round(F.col("avg_roas") - F.col("avg_breakeven"), 2).alias("roas_vs_breakeven_gap"),
            *verdict.columns("spend_verdict", flag_nulls),
        )
        .orderBy(highest_first("total_spend"), "platform", "product")
    )


def avg_frequency_by_platform(master: DataFrame) -> DataFrame:
    """Q27. Mean frequency per platform."""
    return master.groupBy("platform").agg(mean_to("frequency", 2).alias("avg_frequency"))


def distinct_frequency(master: DataFrame, k: int = 20) -> DataFrame:
    """Q28. The ``k`` lowest distinct frequencies."""
    return master.select("frequency").distinct().orderBy("frequency").limit(k)


def total_reach(master: DataFrame) -> DataFrame:
    """Q29. Reach over all campaigns."""
    return master.agg(F.sum("reach").alias("total_reach"))
