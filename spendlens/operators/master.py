"""The two master data sets that dashboards read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions.numeric import pct
from .model import Star

# The columns of the two masters, in view order.
PERFORMANCE_MASTER = (
    "row_id", "campaign_id", "campaign_name", "ad_id", "date", "day_of_week", "week_number", "month_number",
    "month_name", "quarter", "quarter_label", "year", "year_quarter", "year_month", "is_weekend", "platform",
    "product", "hook_type", "creative_angle", "copy_tone", "ad_format", "has_ugc", "selling_price",
    "product_cost", "gross_margin_pct", "impressions", "reach", "frequency", "fatigue_score", "fatigue_status",
    "creative_score", "hook_rate", "hold_rate_3s", "completion_rate", "funnel_dropoff_rate", "spend", "cpm",
    "clicks", "ctr", "cpc", "purchases", "cvr", "cpa", "gross_revenue", "net_revenue", "roas", "breakeven_roas",
    "performance_category",
)
PROFITABILITY_MASTER = (
    "row_id", "ad_id", "date", "month_name", "month_number", "quarter", "quarter_label", "year", "year_quarter",
    "year_month", "platform", "product", "selling_price", "product_cost", "gross_margin_pct", "spend",
    "purchases", "fatigue_score", "fatigue_status", "gross_revenue", "discount_amount", "refund_amount",
    "net_revenue", "roas", "breakeven_roas", "contribution_margin", "fixed_cost_allocation", "net_profit",
    "performance_category",
)


def creative_combination(separator: str = " | ", ugc: str = "UGC", no_ugc: str = "Non UGC") -> Column:
    """Hook, angle, tone, format and UGC flag in one label; NULL if one of the texts is NULL."""
    made_by = F.when(F.col("has_ugc") == 1, F.lit(ugc)).otherwise(F.lit(no_ugc))
    parts: list[Column] = []
    for name in ("hook_type", "creative_angle", "copy_tone", "ad_format"):
        parts += [F.col(name), F.lit(separator)]
    return F.concat(*parts, made_by)


def leakage_pcts() -> list[Column]:
    """Share of gross revenue lost to discounts and refunds, and the share kept."""
    return [
        pct("discount_amount", "gross_revenue").alias("discount_leakage_pct"),
        pct("refund_amount", "gross_revenue").alias("refund_leakage_pct"),
        pct("net_revenue", "gross_revenue").alias("revenue_retention_pct"),
    ]


def roas_vs_breakeven_gap() -> Column:
    return F.round(F.col("roas") - F.col("breakeven_roas"), 2).alias("roas_vs_breakeven_gap")


def performance_columns(facts: DataFrame, flag_nulls: bool = False) -> DataFrame:
    """The performance master from wide campaign rows."""
    decision = ladders.scalability("roas", "breakeven_roas", "fatigue_status")
    return facts.select(
        *PERFORMANCE_MASTER,
        *decision.columns("scalability_decision", flag_nulls),
        creative_combination().alias("creative_combination"),
    )


def profitability_columns(facts: DataFrame, flag_nulls: bool = False) -> DataFrame:
    """The profitability master from wide campaign rows."""
    advice = ladders.recommendation("net_profit", "roas", "breakeven_roas", "fatigue_score")
    return facts.select(
        *PROFITABILITY_MASTER,
        *leakage_pcts(),
        roas_vs_breakeven_gap(),
        *ladders.profit_status("net_profit").columns("profit_status", flag_nulls),
        *advice.columns("ceo_recommendation", flag_nulls),
    )


def performance_master(star: Star, flag_nulls: bool = False) -> DataFrame:
    return performance_columns(star.facts(), flag_nulls)


def profitability_master(star: Star, flag_nulls: bool = False) -> DataFrame:
    return profitability_columns(star.facts(), flag_nulls)
