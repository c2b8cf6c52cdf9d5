"""Profitability: revenue, leakage, margins and what is left after all costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions.numeric import exact, mean, mean_to, money_ratio, pct, rnd, sdiv, sum_to, sum_where
from ..labels import BREAKEVEN_VERDICTS, MARGIN_HEALTH, MARGIN_VERDICTS, PLATFORM_EFFICIENCY, PROFIT_STATUS
from .common import campaigns, highest_first, lowest_first, spend_total

# Waterfall columns of the revenue table -> base of their total's name.
WATERFALL = {
    "gross": "gross_revenue",
    "discounts": "discount_amount",
    "refunds": "refund_amount",
    "net": "net_revenue",
    "margin": "contribution_margin",
    "fixed": "fixed_cost_allocation",
    "profit": "net_profit",
}


def _total(part: str, name: str) -> Column:
    return sum_to(WATERFALL[part]).alias(name)


def _share_of(part: str, whole: str) -> Column:
    """Percentage of two totals."""
    return pct(F.sum(WATERFALL[part]), F.sum(WATERFALL[whole]))


def gross_revenue_leaders(facts: DataFrame) -> DataFrame:
    """Q14. Where gross revenue comes from."""
    return (
        facts.groupBy("platform", "product")
        .agg(
            campaigns("total_campaigns"),
            F.sum("purchases").alias("total_purchases"),
            _total("gross", "total_gross_revenue"),
            spend_total(),
            rnd(sdiv(F.sum("gross_revenue"), F.sum("spend")), 2).alias("gross_roas"),
            mean_to("gross_revenue", 2).alias("avg_gross_per_campaign"),
        )
        .orderBy(highest_first("total_gross_revenue"), "platform", "product")
    )


def quarterly_gross_trend(facts: DataFrame) -> DataFrame:
    """Q15. Gross and net revenue by quarter."""
    return (
        facts.groupBy("year_quarter", "year", "quarter")
        .agg(
            _total("gross", "total_gross_revenue"),
            _total("net", "total_net_revenue"),
            spend_total(),
            mean_to("roas", 2).alias("avg_roas"),
            F.round(F.sum("gross_revenue") - F.sum("net_revenue"), 2).alias("total_deductions"),
        )
        .orderBy("year", "quarter")
    )


def revenue_leakage(facts: DataFrame) -> DataFrame:
    """Q16. Revenue lost to discounts and refunds; worst retention first."""
    return (
        facts.groupBy("product", "platform")
        .agg(
            _total("gross", "total_gross"),
            _total("discounts", "total_discounts"),
            _total("refunds", "total_refunds"),
            _total("net", "total_net_revenue"),
            _share_of("discounts", "gross").alias("discount_leakage_pct"),
            _share_of("refunds", "gross").alias("refund_leakage_pct"),
            _share_of("net", "gross").alias("revenue_retention_pct"),
        )
        .orderBy(lowest_first("revenue_retention_pct"), "product", "platform")
    )


def quarterly_leakage(facts: DataFrame) -> DataFrame:
    """Q17. Gross to net by quarter."""
    return (
        facts.groupBy("year_quarter", "quarter")
        .agg(
            _total("gross", "total_gross"),
            _total("discounts", "total_discounts"),
            _total("refunds", "total_refunds"),
            _total("net", "total_net"),
            _share_of("net", "gross").alias("revenue_retention_pct"),
        )
        .orderBy("year_quarter")
    )


def _product_margins(facts: DataFrame) -> DataFrame:
    return facts.groupBy("product").agg(
        _total("gross", "total_gross_revenue"),
        _total("net", "total_net_revenue"),
        _total("margin", "total_contribution_margin"),
        money_ratio(F.sum("contribution_margin"), F.sum("net_revenue")).alias("_margin"),
    )


def contribution_by_product(
    facts: DataFrame, cuts: Sequence[float] = (0.15, 0.30), labels=MARGIN_HEALTH, flag_nulls: bool = False
) -> DataFrame:
    """Q18. Contribution margin per product, judged on the unrounded ratio."""
    return (
        _product_margins(facts)
        .select(
            "product",
            "total_net_revenue",
            "total_contribution_margin",
            rnd(F.col("_margin") * 100, 2).alias("margin_retention_pct"),
            *ladders.below("_margin", cuts, labels).columns("margin_health", flag_nulls),
        )
        .orderBy(highest_first("total_contribution_margin"), "product")
    )


def contribution_per_spend(
    facts: DataFrame, cuts: Sequence[float] = (0.5, 0.2), labels=PLATFORM_EFFICIENCY, flag_nulls: bool = False
) -> DataFrame:
    """Q19. Contribution margin per unit of ad spend."""
    per_platform = facts.groupBy("platform").agg(
        _total("margin", "total_contribution_margin"),
        spend_total(),
        money_ratio(F.sum("contribution_margin"), F.sum("spend")).alias("_return"),
    )
    return per_platform.select(
        "platform",
        "total_contribution_margin",
        "total_spend",
        rnd("_return", 2).alias("contribution_per_spend"),
        *ladders.at_least("_return", cuts, labels).columns("platform_efficiency", flag_nulls),
    ).orderBy(highest_first("contribution_per_spend"), "platform")


def margin_illusion(
    facts: DataFrame, cuts: Sequence[float] = (0.15, 0.30), labels=MARGIN_VERDICTS, flag_nulls: bool = False
) -> DataFrame:
    """Q20. Strong revenue with a thin margin."""
    return (
        _product_margins(facts)
        .select(
            "product",
            "total_gross_revenue",
            "total_net_revenue",
            "total_contribution_margin",
            rnd(F.col("_margin") * 100, 2).alias("margin_pct"),
            *ladders.below("_margin", cuts, labels).columns("margin_verdict", flag_nulls),
        )
        .orderBy(highest_first("total_gross_revenue"), "product")
    )


def true_profit_by_quarter(facts: DataFrame, labels=PROFIT_STATUS, flag_nulls: bool = False) -> DataFrame:
    """Q21. The waterfall from gross revenue to net profit."""
    grouped = facts.groupBy("product", "year_quarter").agg(
        _total("gross", "total_gross_revenue"),
        F.round(F.sum(F.col("discount_amount") + F.col("refund_amount")), 2).alias("total_deductions"),
        _total("net", "total_net_revenue"),
        _total("margin", "total_contribution_margin"),
        _total("fixed", "total_fixed_costs"),
        _total("profit", "total_net_profit"),
        _share_of("profit", "net").alias("net_profit_margin_pct"),
        F.sum("net_profit").alias("_profit"),
    )
    status = ladders.profit_status("_profit", labels)
    return status.add_to(grouped, "profit_status", flag_nulls).drop("_profit").orderBy("product", "year_quarter")


def quarter_operating_cost(facts: DataFrame) -> DataFrame:
    """Q22. What a quarter costs to run against what it earns."""
    label = F.concat_ws("", "quarter_label", F.lit(" "), F.col("year").cast("string"))
    grouped = facts.groupBy("year", "quarter", "quarter_label").agg(
        _total("gross", "total_gross_revenue"),
        _total("net", "total_net_revenue"),
        spend_total("total_ad_spend"),
        _total("fixed", "total_fixed_costs"),
        _total("margin", "total_contribution_margin"),
        _total("profit", "total_net_profit"),
        pct(F.sum("net_profit"), F.sum("spend")).alias("profit_per_spend_pct"),
    )
    totals = [c for c in grouped.columns if c not in ("year", "quarter", "quarter_label")]
    return grouped.select("year", "quarter", label.alias("quarter_label_full"), *totals).orderBy(
        highest_first("total_net_profit"), "year", "quarter"
    )


def breakeven_illusion(
    facts: DataFrame, strong: float = 1.2, floor: float = 1.5, labels=BREAKEVEN_VERDICTS, flag_nulls: bool = False
) -> DataFrame:
    """Q23. ROAS that looks good but lies below breakeven, judged on unrounded means."""
    below = F.col("roas") < F.col("breakeven_roas")
    grouped = facts.groupBy("product", "platform").agg(
        mean("roas").alias("_roas"),
        mean("breakeven_roas").alias("_breakeven"),
        campaigns("total_campaigns"),
        sum_where(below, F.lit(1)).alias("loss_making_campaigns"),
        F.round(sum_where(below, "spend"), 2).alias("spend_below_breakeven"),
    )
    roas, breakeven = F.col("_roas"), F.col("_breakeven")
    verdict = ladders.Ladder(
        (
            (roas >= breakeven * exact(strong), labels[0]),
            (roas >= breakeven, labels[1]),
            (roas >= exact(floor), labels[2]),
        ),
        labels[3],
        (roas, breakeven),
    )
    return grouped.select(
        "product",
        "platform",
        rnd(roas, 2).alias("avg_roas"),
        rnd(breakeven, 2).alias("avg_breakeven"),
        rnd(roas - breakeven, 2).alias("roas_gap"),
        "total_campaigns",
        "loss_making_campaigns",
        "spend_below_breakeven",
        *verdict.columns("profitability_verdict", flag_nulls),
    ).orderBy(lowest_first("roas_gap"), "product", "platform")
