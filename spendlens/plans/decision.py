"""Decisions: spend that never breaks even and where the budget should go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions.ladders import position_in
from ..functions.numeric import mean_to, pct, sum_to, sum_where
from ..labels import LOSS_CATEGORIES, PERFORMANCE_CATEGORIES, RECOMMENDATION
from .common import campaigns, highest_first, roas_pair, spend_total, with_total


def category_spend(facts: DataFrame, order: Sequence[str] = PERFORMANCE_CATEGORIES) -> DataFrame:
    """Q24a. Spend per performance category, best category first."""
    per_category = facts.groupBy("performance_category").agg(spend_total(), campaigns("campaigns"), *roas_pair())
    return (
        with_total(per_category, "total_spend", "_all_spend")
        .select(
            "performance_category",
            "total_spend",
            pct("total_spend", "_all_spend").alias("spend_share_pct"),
            "campaigns",
            "avg_roas",
            "avg_breakeven",
        )
        .orderBy(position_in("performance_category", order), "performance_category")
    )


def wasted_spend(facts: DataFrame, losing: Sequence[str] = LOSS_CATEGORIES) -> DataFrame:
    """Q24b. Spend in the losing categories and its share of all spend."""
    lost = sum_where(F.col("performance_category").isin(*losing), "spend")
    return facts.agg(
        F.round(lost, 2).alias("wasted_spend"), pct(lost, F.sum("spend")).alias("wasted_spend_pct")
    )


def budget_recommendation(
    facts: DataFrame,
    strong: float = 1.2,
    near: float = 0.9,
    worn: float = 5,
    labels=RECOMMENDATION,
    flag_nulls: bool = False,
) -> DataFrame:
    """Q25. Advice per product and platform, from the rounded figures."""
    grouped = facts.groupBy("product", "platform").agg(
        spend_total(),
        sum_to("net_revenue").alias("total_net_revenue"),
        sum_to("contribution_margin").alias("total_contribution_margin"),
        sum_to("net_profit").alias("total_net_profit"),
        *roas_pair(),
        mean_to("fatigue_score", 1).alias("avg_fatigue"),
    )
    advice = ladders.recommendation(
        "total_net_profit", "avg_roas", "avg_breakeven", "avg_fatigue", strong, near, worn, labels
    )
    return (
        advice.add_to(grouped, "ceo_recommendation", flag_nulls)
        .orderBy(advice.rank, highest_first("total_net_profit"), "product", "platform")
    )


def double_down(facts: DataFrame, labels=RECOMMENDATION, **thresholds) -> DataFrame:
    """Q26. The cells whose advice is to double the budget."""
    advised = budget_recommendation(facts, labels=labels, **thresholds)
    return advised.filter(F.col("ceo_recommendation") == labels[0])
