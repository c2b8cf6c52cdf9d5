"""Interest and conversion: click quality, the leaking funnel and click traps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ladders import Ladder
from ..functions.numeric import exact, mean_to, pct, rnd, sdiv, sum_to
from ..labels import CLICK_TRAP, FUNNEL_DIAGNOSES
from .common import CREATIVE_GRAIN, campaigns, highest_first, lowest_first, roas_pair, spend_total


def click_quality(facts: DataFrame) -> DataFrame:
    """Q7. Clicks per platform: mean of the click-through rates next to the blended rate."""
    return (
        facts.groupBy("platform")
        .agg(
            campaigns("total_campaigns"),
            F.sum("clicks").alias("total_clicks"),
            F.sum("impressions").alias("total_impressions"),
            mean_to("ctr", 4).alias("avg_ctr"),
            mean_to("cpc", 2).alias("avg_cpc"),
            spend_total(),
            rnd(sdiv(F.sum("clicks"), F.sum("impressions")), 4).alias("blended_ctr"),
        )
        .orderBy(highest_first("blended_ctr"), "platform")
    )


def audience_quality(facts: DataFrame, min_ads: int = 10, k: int = 20) -> DataFrame:
    """Q8. Creative combinations with the highest mean click-through rate."""
    grain = ("hook_type", "creative_angle", "ad_format", "has_ugc")
    return (
        facts.groupBy(*grain)
        .agg(
            campaigns("total_ads"),
            mean_to("ctr", 4).alias("avg_ctr"),
            mean_to("cpc", 2).alias("avg_cpc"),
            mean_to("cvr", 4).alias("avg_cvr"),
            mean_to("roas", 2).alias("avg_roas"),
        )
        .filter(F.col("total_ads") >= min_ads)
        .orderBy(highest_first("avg_ctr"), *grain)
        .limit(k)
    )


def funnel_leak(
    facts: DataFrame, ctr_pct: float = 2, cvr_pct: float = 3, labels=FUNNEL_DIAGNOSES, flag_nulls: bool = False
) -> DataFrame:
    """Q9. Where the funnel leaks, judged on the rounded percentages."""
    totals = facts.groupBy("platform", "product").agg(
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("purchases").alias("total_purchases"),
    )
    rates = totals.select(
        "*",
        pct("total_clicks", "total_impressions").alias("impression_to_click_pct"),
        pct("total_purchases", "total_clicks").alias("click_to_purchase_pct"),
        pct("total_purchases", "total_impressions", 4).alias("overall_funnel_pct"),
    )
    click, buy = F.col("impression_to_click_pct"), F.col("click_to_purchase_pct")
    diagnosis = Ladder(
        ((click < exact(ctr_pct), labels[0]), (buy < exact(cvr_pct), labels[1])), labels[2], (click, buy)
    )
    return diagnosis.add_to(rates, "funnel_diagnosis", flag_nulls).orderBy(
        lowest_first("overall_funnel_pct"), "platform", "product"
    )


def click_traps(
    facts: DataFrame, ctr: float = 0.03, cvr: float = 0.02, min_campaigns: int = 5, label: str = CLICK_TRAP
) -> DataFrame:
    """Q10a. Creatives that are clicked but not bought from, by their rounded means."""
    grain = (*CREATIVE_GRAIN, "creative_angle", "copy_tone")
    return (
        facts.groupBy(*grain)
        .agg(
            mean_to("ctr", 4).alias("avg_ctr"),
            mean_to("cvr", 4).alias("avg_cvr"),
            *roas_pair(),
            spend_total(),
            campaigns("campaign_count"),
        )
        .filter(F.col("campaign_count") >= min_campaigns)
        .filter((F.col("avg_ctr") > exact(ctr)) & (F.col("avg_cvr") < exact(cvr)))
        .withColumn("creative_diagnosis", F.lit(label))
        .orderBy(highest_first("total_spend"), *grain)
    )


def click_trap_waste(traps: DataFrame) -> DataFrame:
    """Q10b. Number of click traps and the spend on them."""
    return traps.agg(campaigns("click_trap_count"), sum_to("total_spend").alias("total_wasted_spend"))
