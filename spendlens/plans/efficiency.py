"""Efficiency: fatigue, scaling decisions and seasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions.numeric import mean, mean_to, rnd
from ..labels import FATIGUE_BANDS, QUARTER_STATUS, SCALABILITY
from .common import (
    campaigns,
    change_along_chunks,
    change_from_previous,
    highest_first,
    roas_pair,
    spend_total,
)


def fatigue_bands(facts: DataFrame, edges=(2, 4, 6, 8), labels=FATIGUE_BANDS, per_ad: bool = False) -> DataFrame:
    """Q11. Means per fatigue band of each ad, and the step in mean ROAS to the row before.

    The row before is the previous one of the platform in the order band,
    product, ad. With ``per_ad`` it is the previous band of the same ad, which
    is what the column name promises.
    """
    band = ladders.fatigue_band("fatigue_score", edges, labels).label.alias("fatigue_band")
    grouped = facts.groupBy("platform", "product", "ad_id", band).agg(
        mean_to("frequency", 2).alias("avg_frequency"),
        mean_to("hook_rate", 4).alias("avg_hook_rate"),
        mean_to("ctr", 4).alias("avg_ctr"),
        mean_to("cvr", 4).alias("avg_cvr"),
        mean_to("roas", 2).alias("avg_roas"),
        campaigns("total_campaigns"),
    )
    step = "roas_change_vs_prev_band"
    if per_ad:
        stepped = change_from_previous(
            grouped, "avg_roas", step, ["platform", "product", "ad_id"], ["fatigue_band"]
        )
    else:
        stepped = change_along_chunks(
            grouped, "avg_roas", step, ["platform"], ["fatigue_band", "product"], "ad_id"
        )
    return stepped.orderBy("platform", "fatigue_band", "product", "ad_id")


def scalability_matrix(facts: DataFrame, labels=SCALABILITY, flag_nulls: bool = False) -> DataFrame:
    """Q12. Scale, monitor, optimise or kill, decided on unrounded means."""
    grain = ("platform", "product", "ad_id", "hook_type", "fatigue_status")
    grouped = facts.groupBy(*grain).agg(
        mean_to("fatigue_score", 1).alias("avg_fatigue"),
        mean("roas").alias("_roas"),
        mean("breakeven_roas").alias("_breakeven"),
        spend_total(),
    )
    decision = ladders.scalability("_roas", "_breakeven", "fatigue_status", labels=labels)
    return (
        grouped.select(
            *grain[:4],
            "avg_fatigue",
            "fatigue_status",
            rnd("_roas", 2).alias("avg_roas"),
            rnd("_breakeven", 2).alias("avg_breakeven"),
            rnd(F.col("_roas") - F.col("_breakeven"), 2).alias("roas_vs_breakeven_gap"),
            "total_spend",
            *decision.columns("scalability_decision", flag_nulls),
            decision.rank.alias("_rank"),
        )
        .orderBy("_rank", highest_first("total_spend"), *grain)
        .drop("_rank")
    )


def quarterly_performance(facts: DataFrame, labels=QUARTER_STATUS, flag_nulls: bool = False) -> DataFrame:
    """Q13. Seasonal means per product and platform, the step to the quarter before, and a status."""
    grouped = facts.groupBy("product", "platform", "year_quarter", "year", "quarter").agg(
        *roas_pair(), spend_total(), campaigns("campaigns")
    )
    stepped = change_from_previous(
        grouped, "avg_roas", "roas_change_vs_prev_quarter", ["product", "platform"], ["year", "quarter"]
    )
    roas, breakeven = F.col("avg_roas"), F.col("avg_breakeven")
    status = ladders.Ladder(((roas >= breakeven, labels[0]),), labels[1], (roas, breakeven))
    return status.add_to(stepped, "quarter_status", flag_nulls).orderBy("product", "platform", "year", "quarter")
