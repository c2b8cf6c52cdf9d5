"""DuckDB formulation of the analytical questions, over the wide ``facts`` rows."""

from __future__ import annotations

from .prelude import on_facts, ratio, rnd


def mean(column: str, digits: int) -> str:
    return rnd(f"avg({column})", digits)


def total(column: str) -> str:
    return f"round(sum({column}), 2)"


def per(grain: str, figures: dict[str, str], having: str = "") -> str:
    """Aggregate of ``facts`` at a grain: alias -> expression."""
    listed = ", ".join(f"{expression} AS {alias}" for alias, expression in figures.items())
    lead = f"{grain}, " if grain else ""
    tail = f" GROUP BY {grain}" if grain else ""
    return f"SELECT {lead}{listed} FROM facts{tail}{' HAVING ' + having if having else ''}"


def share(top: str, bottom: str, digits: int = 2) -> str:
    return rnd(f"{ratio(top, bottom)} * 100", digits)


# The conditions of the three published ladders, in their published order.
def scale_label(roas: str, breakeven: str, status: str) -> str:
    return (
        f"CASE WHEN {roas} >= {breakeven} AND {status} = 'Low Fatigue' THEN 'Scale' "
        f"WHEN {roas} >= {breakeven} AND {status} = 'Medium Fatigue' THEN 'Monitor' "
        f"WHEN {roas} < {breakeven} AND {status} = 'Low Fatigue' THEN 'Optimise' ELSE 'Kill' END"
    )


def advice_label(profit: str, roas: str, breakeven: str, fatigue: str, worn: str = "5") -> str:
    return (
        f"CASE WHEN {profit} > 0 AND {roas} >= {breakeven} * 1.2 AND {fatigue} < {worn} THEN 'Double Down' "
        f"WHEN {profit} > 0 AND {fatigue} >= {worn} THEN 'Maintain' "
        f"WHEN {profit} <= 0 AND {roas} >= {breakeven} * 0.9 THEN 'Optimise' ELSE 'Deprioritise' END"
    )


def profit_label(profit: str) -> str:
    return f"CASE WHEN {profit} > 0 THEN 'Profitable' WHEN {profit} = 0 THEN 'Break-Even' ELSE 'Loss' END"


N = "count(*)"
PAIR = {"avg_roas": mean("roas", 2), "avg_breakeven": mean("breakeven_roas", 2)}
SPEND = {"total_spend": total("spend")}
ATTENTION = {
    "avg_hook_rate": mean("hook_rate", 4),
    "avg_hold_rate": mean("hold_rate_3s", 4),
    "avg_completion_rate": mean("completion_rate", 4),
}

_TRAPS = per(
    "ad_id, platform, product, hook_type, ad_format",
    {
        "avg_hook_rate": mean("hook_rate", 4),
        "avg_completion_rate": mean("completion_rate", 4),
        "avg_cvr": mean("cvr", 4),
        "avg_roas": mean("roas", 2),
        **SPEND,
    },
    "avg(hook_rate) > 0.18 AND avg(completion_rate) < 0.05",
)
_TRAP_DOUBLES = "avg_hook_rate avg_completion_rate avg_cvr avg_roas total_spend"
_CLICK_TRAPS = (
    "SELECT *, 'Click Trap attracting wrong audience' AS creative_diagnosis FROM ("
    + per(
        "ad_id, platform, product, hook_type, creative_angle, copy_tone",
        {"avg_ctr": mean("ctr", 4), "avg_cvr": mean("cvr", 4), **PAIR, **SPEND, "campaign_count": N},
        f"count(*) >= 5 AND {mean('ctr', 4)} > 0.03 AND {mean('cvr', 4)} < 0.02",
    )
    + ")"
)
_BANDED = (
    "WITH banded AS (SELECT *, CASE WHEN fatigue_score < 2 THEN '1. Low (0-2)' WHEN fatigue_score < 4 THEN "
    "'2. Low-Mid (2-4)' WHEN fatigue_score < 6 THEN '3. Mid (4-6)' WHEN fatigue_score < 8 THEN '4. High (6-8)' "
    "ELSE '5. Critical (8-10)' END AS fatigue_band FROM facts), bands AS ("
    + per(
        "platform, product, ad_id, fatigue_band",
        {
            "avg_frequency": mean("frequency", 2),
            "avg_hook_rate": mean("hook_rate", 4),
            "avg_ctr": mean("ctr", 4),
            "avg_cvr": mean("cvr", 4),
            "avg_roas": mean("roas", 2),
            "total_campaigns": N,
        },
    ).replace("FROM facts", "FROM banded")
    + ") "
)
_BAND_DOUBLES = "avg_frequency avg_hook_rate avg_ctr avg_cvr avg_roas roas_change_vs_prev_band"
_CELLS = per(
    "product, platform",
    {
        **SPEND,
        "total_net_revenue": total("net_revenue"),
        "total_contribution_margin": total("contribution_margin"),
        "total_net_profit": total("net_profit"),
        **PAIR,
        "avg_fatigue": mean("fatigue_score", 1),
    },
)
_CELL_DOUBLES = (
    "total_spend total_net_revenue total_contribution_margin total_net_profit avg_roas avg_breakeven avg_fatigue"
)


def _advised(worn: str) -> str:
    label = advice_label("total_net_profit", "avg_roas", "avg_breakeven", "avg_fatigue", worn)
    return f"SELECT *, {label} AS ceo_recommendation FROM ({_CELLS})"


def _shares(keyed: str, shown: str) -> str:
    """Adds each row's share of all spend."""
    share_of_all = rnd("cast(total_spend AS double) / sum(total_spend) OVER () * 100", 2)
    return f"SELECT {shown.replace('SHARE', share_of_all + ' AS spend_share_pct')} FROM ({keyed})"


_MARGIN = ratio("sum(contribution_margin)", "sum(net_revenue)")


def _margin_label(thin: str, moderate: str) -> str:
    return f"CASE WHEN {_MARGIN} < 0.15 THEN '{thin}' WHEN {_MARGIN} < 0.30 THEN '{moderate}' ELSE 'Healthy Margin' END"


def _gross_share(column: str) -> str:
    return share(f"sum({column})", "sum(gross_revenue)")


_RETURN = ratio("sum(contribution_margin)", "sum(spend)")

QUESTIONS: dict[str, str] = {
    "Q1_avg_roas_by_platform": on_facts(per("platform", {"avg_roas": mean("roas", 2)}), "avg_roas"),
    "Q2_reach_by_platform": on_facts(
        per(
            "platform",
            {
                "total_campaigns": N,
                "total_impressions": "sum(impressions)",
                "total_reach": "sum(reach)",
                "avg_frequency": mean("frequency", 2),
                "avg_fatigue_score": mean("fatigue_score", 2),
                **SPEND,
                "cost_per_unique_reach": rnd(ratio("sum(spend)", "sum(reach)"), 4),
            },
        ),
        "avg_frequency avg_fatigue_score total_spend cost_per_unique_reach",
        "total_impressions total_reach",
    ),
    "Q3_spend_verdict": on_facts(
        _shares(
            per("platform, product", {**SPEND, **PAIR}),
            "platform, product, total_spend, SHARE, avg_roas, avg_breakeven, "
            "avg_roas - avg_breakeven AS roas_vs_breakeven_gap, "
            "if(avg_roas >= avg_breakeven, 'Spend Justified', 'Spend Not Justified') AS spend_verdict",
        ),
        "total_spend spend_share_pct avg_roas avg_breakeven roas_vs_breakeven_gap",
    ),
    "Q4_scroll_stoppers": on_facts(
        per(
            "hook_type, creative_angle, copy_tone, has_ugc",
            {"total_ads": N, **ATTENTION, "avg_roas": mean("roas", 2)},
            "count(*) >= 10",
        )
        + " ORDER BY avg_hook_rate DESC NULLS FIRST, hook_type, creative_angle, copy_tone, has_ugc LIMIT 20",
        "avg_hook_rate avg_hold_rate avg_completion_rate avg_roas",
    ),
    "Q5_attention_retention": on_facts(
        per(
            "platform, ad_format",
            {
                "total_ads": N,
                **ATTENTION,
                "hook_to_hold_ratio": rnd(ratio("avg(hold_rate_3s)", "avg(hook_rate)"), 4),
                "hold_to_completion_ratio": rnd(ratio("avg(completion_rate)", "avg(hold_rate_3s)"), 4),
            },
        ),
        "avg_hook_rate avg_hold_rate avg_completion_rate hook_to_hold_ratio hold_to_completion_ratio",
    ),
    "Q6a_attention_traps": on_facts(_TRAPS, _TRAP_DOUBLES),
    "Q6b_attention_trap_retention": on_facts(
        f"SELECT *, {rnd(ratio('avg_completion_rate', 'avg_hook_rate'), 4)} AS retention_ratio FROM ({_TRAPS})",
        _TRAP_DOUBLES + " retention_ratio",
    ),
    "Q6c_attention_trap_spend": on_facts(
        f"SELECT count(*) AS trap_count, sum(total_spend) AS spend_on_traps FROM ({_TRAPS})", "spend_on_traps"
    ),
    "Q7_click_quality": on_facts(
        per(
            "platform",
            {
                "total_campaigns": N,
                "total_clicks": "sum(clicks)",
                "total_impressions": "sum(impressions)",
                "avg_ctr": mean("ctr", 4),
                "avg_cpc": mean("cpc", 2),
                **SPEND,
                "blended_ctr": rnd(ratio("sum(clicks)", "sum(impressions)"), 4),
            },
        ),
        "avg_ctr avg_cpc total_spend blended_ctr",
        "total_clicks total_impressions",
    ),
    "Q8_audience_quality": on_facts(
        per(
            "hook_type, creative_angle, ad_format, has_ugc",
            {
                "total_ads": N,
                "avg_ctr": mean("ctr", 4),
                "avg_cpc": mean("cpc", 2),
                "avg_cvr": mean("cvr", 4),
                "avg_roas": mean("roas", 2),
            },
            "count(*) >= 10",
        )
        + " ORDER BY avg_ctr DESC NULLS FIRST, hook_type, creative_angle, ad_format, has_ugc LIMIT 20",
        "avg_ctr avg_cpc avg_cvr avg_roas",
    ),
    "Q9_funnel_leak": on_facts(
        "SELECT *, CASE WHEN impression_to_click_pct < 2 THEN 'Traffic Problem — low CTR before click' "
        "WHEN click_to_purchase_pct < 3 THEN 'Conversion Problem — low CVR after click' "
        "ELSE 'Funnel Healthy' END AS funnel_diagnosis FROM ("
        + per(
            "platform, product",
            {
                "total_impressions": "sum(impressions)",
                "total_clicks": "sum(clicks)",
                "total_purchases": "sum(purchases)",
                "impression_to_click_pct": share("sum(clicks)", "sum(impressions)"),
                "click_to_purchase_pct": share("sum(purchases)", "sum(clicks)"),
                "overall_funnel_pct": share("sum(purchases)", "sum(impressions)", 4),
            },
        )
        + ")",
        "impression_to_click_pct click_to_purchase_pct overall_funnel_pct",
        "total_impressions total_clicks total_purchases",
    ),
    "Q10a_click_traps": on_facts(_CLICK_TRAPS, "avg_ctr avg_cvr avg_roas avg_breakeven total_spend"),
    "Q10b_click_trap_waste": on_facts(
        f"SELECT count(*) AS click_trap_count, sum(total_spend) AS total_wasted_spend FROM ({_CLICK_TRAPS})",
        "total_wasted_spend",
    ),
    "Q11_fatigue_bands": on_facts(
        _BANDED
        + "SELECT *, avg_roas - lag(avg_roas) OVER (PARTITION BY platform ORDER BY fatigue_band, product, ad_id) "
        "AS roas_change_vs_prev_band FROM bands",
        _BAND_DOUBLES,
    ),
    "Q11_fatigue_bands_per_ad": on_facts(
        _BANDED
        + "SELECT *, avg_roas - lag(avg_roas) OVER (PARTITION BY platform, product, ad_id ORDER BY fatigue_band) "
        "AS roas_change_vs_prev_band FROM bands",
        _BAND_DOUBLES,
    ),
    "Q12_scalability_matrix": on_facts(
        per(
            "platform, product, ad_id, hook_type, fatigue_status",
            {
                "avg_fatigue": mean("fatigue_score", 1),
                **PAIR,
                "roas_vs_breakeven_gap": rnd("avg(roas) - avg(breakeven_roas)", 2),
                **SPEND,
                "scalability_decision": scale_label("avg(roas)", "avg(breakeven_roas)", "fatigue_status"),
            },
        ),
        "avg_fatigue avg_roas avg_breakeven roas_vs_breakeven_gap total_spend",
    ),
    "Q13_quarterly_performance": on_facts(
        "SELECT *, avg_roas - lag(avg_roas) OVER (PARTITION BY product, platform ORDER BY year_quarter) "
        "AS roas_change_vs_prev_quarter, if(avg_roas >= avg_breakeven, 'Profitable', 'Below Breakeven') "
        "AS quarter_status FROM ("
        + per("product, platform, year_quarter, year, quarter", {**PAIR, **SPEND, "campaigns": N})
        + ")",
        "avg_roas avg_breakeven total_spend roas_change_vs_prev_quarter",
    ),
    "Q14_gross_revenue_leaders": on_facts(
        per(
            "platform, product",
            {
                "total_campaigns": N,
                "total_purchases": "sum(purchases)",
                "total_gross_revenue": total("gross_revenue"),
                **SPEND,
                "gross_roas": rnd(ratio("sum(gross_revenue)", "sum(spend)"), 2),
                "avg_gross_per_campaign": mean("gross_revenue", 2),
            },
        ),
        "total_gross_revenue total_spend gross_roas avg_gross_per_campaign",
        "total_purchases",
    ),
    "Q15_quarterly_gross_trend": on_facts(
        per(
            "year_quarter, year, quarter",
            {
                "total_gross_revenue": total("gross_revenue"),
                "total_net_revenue": total("net_revenue"),
                **SPEND,
                "avg_roas": mean("roas", 2),
                "total_deductions": "sum(gross_revenue - net_revenue)",
            },
        ),
        "total_gross_revenue total_net_revenue total_spend avg_roas total_deductions",
    ),
    "Q16_revenue_leakage": on_facts(
        per(
            "product, platform",
            {
                "total_gross": total("gross_revenue"),
                "total_discounts": total("discount_amount"),
                "total_refunds": total("refund_amount"),
                "total_net_revenue": total("net_revenue"),
                "discount_leakage_pct": _gross_share("discount_amount"),
                "refund_leakage_pct": _gross_share("refund_amount"),
                "revenue_retention_pct": _gross_share("net_revenue"),
            },
        ),
        "total_gross total_discounts total_refunds total_net_revenue discount_leakage_pct refund_leakage_pct "
        "revenue_retention_pct",
    ),
    "Q17_quarterly_leakage": on_facts(
        per(
            "year_quarter, quarter",
            {
                "total_gross": total("gross_revenue"),
                "total_discounts": total("discount_amount"),
                "total_refunds": total("refund_amount"),
                "total_net": total("net_revenue"),
                "revenue_retention_pct": _gross_share("net_revenue"),
            },
        ),
        "total_gross total_discounts total_refunds total_net revenue_retention_pct",
    ),
    "Q18_contribution_by_product": on_facts(
        per(
            "product",
            {
                "total_net_revenue": total("net_revenue"),
                "total_contribution_margin": total("contribution_margin"),
                "margin_retention_pct": rnd(f"{_MARGIN} * 100", 2),
                "margin_health": _margin_label("Danger — Thin Margin", "Moderate — Monitor"),
            },
        ),
        "total_net_revenue total_contribution_margin margin_retention_pct",
    ),
    "Q19_contribution_per_spend": on_facts(
        per(
            "platform",
            {
                "total_contribution_margin": total("contribution_margin"),
                **SPEND,
                "contribution_per_spend": rnd(_RETURN, 2),
                "platform_efficiency": f"CASE WHEN {_RETURN} >= 0.5 THEN 'Efficient Platform' WHEN {_RETURN} >= 0.2 "
                "THEN 'Moderate Platform' ELSE 'Inefficient Platform' END",
            },
        ),
        "total_contribution_margin total_spend contribution_per_spend",
    ),
    "Q20_margin_illusion": on_facts(
        per(
            "product",
            {
                "total_gross_revenue": total("gross_revenue"),
                "total_net_revenue": total("net_revenue"),
                "total_contribution_margin": total("contribution_margin"),
                "margin_pct": rnd(f"{_MARGIN} * 100", 2),
                "margin_verdict": _margin_label(
                    "Margin Illusion — thin margin warning", "Moderate Margin — monitor closely"
                ),
            },
        ),
        "total_gross_revenue total_net_revenue total_contribution_margin margin_pct",
    ),
    "Q21_true_profit_by_quarter": on_facts(
        per(
            "product, year_quarter",
            {
                "total_gross_revenue": total("gross_revenue"),
                "total_deductions": total("discount_amount + refund_amount"),
                "total_net_revenue": total("net_revenue"),
                "total_contribution_margin": total("contribution_margin"),
                "total_fixed_costs": total("fixed_cost_allocation"),
                "total_net_profit": total("net_profit"),
                "net_profit_margin_pct": share("sum(net_profit)", "sum(net_revenue)"),
                "profit_status": profit_label("sum(net_profit)"),
            },
        ),
        "total_gross_revenue total_deductions total_net_revenue total_contribution_margin total_fixed_costs "
        "total_net_profit net_profit_margin_pct",
    ),
    "Q22_quarter_operating_cost": on_facts(
        "SELECT * EXCLUDE (quarter_label) FROM ("
        + per(
            "year, quarter, quarter_label",
            {
                "quarter_label_full": "concat(quarter_label, ' ', year)",
                "total_gross_revenue": total("gross_revenue"),
                "total_net_revenue": total("net_revenue"),
                "total_ad_spend": total("spend"),
                "total_fixed_costs": total("fixed_cost_allocation"),
                "total_contribution_margin": total("contribution_margin"),
                "total_net_profit": total("net_profit"),
                "profit_per_spend_pct": share("sum(net_profit)", "sum(spend)"),
            },
        )
        + ")",
        "total_gross_revenue total_net_revenue total_ad_spend total_fixed_costs total_contribution_margin "
        "total_net_profit profit_per_spend_pct",
    ),
    "Q23_breakeven_illusion": on_facts(
        per(
            "product, platform",
            {
                **PAIR,
                "roas_gap": rnd("avg(roas) - avg(breakeven_roas)", 2),
                "total_campaigns": N,
                "loss_making_campaigns": "count(*) FILTER (WHERE roas < breakeven_roas)",
                "spend_below_breakeven": "coalesce(sum(spend) FILTER (WHERE roas < breakeven_roas), 0)",
                "profitability_verdict": "CASE WHEN avg(roas) >= avg(breakeven_roas) * 1.2 THEN 'Genuinely Profitable' "
                "WHEN avg(roas) >= avg(breakeven_roas) THEN 'Barely Breaking Even' "
                "WHEN avg(roas) >= 1.5 THEN 'Illusion — Losing Money' ELSE 'Obvious Loss' END",
            },
        ),
        "avg_roas avg_breakeven roas_gap spend_below_breakeven",
    ),
    "Q24a_category_spend": on_facts(
        _shares(
            per("performance_category", {**SPEND, "campaigns": N, **PAIR}),
            "performance_category, total_spend, SHARE, campaigns, avg_roas, avg_breakeven",
        ),
        "total_spend spend_share_pct avg_roas avg_breakeven",
    ),
    "Q24b_wasted_spend": on_facts(
        f"SELECT lost AS wasted_spend, {share('lost', 'spent')} AS wasted_spend_pct FROM (SELECT sum(spend) AS spent, "
        "sum(spend) FILTER (WHERE performance_category IN ('Illusion', 'Obvious Loser')) AS lost FROM facts)",
        "wasted_spend wasted_spend_pct",
    ),
    "Q25_budget_recommendation": on_facts(_advised("5"), _CELL_DOUBLES),
    "Q26_double_down": on_facts(
        f"SELECT * FROM ({_advised('5')}) WHERE ceo_recommendation = 'Double Down'", _CELL_DOUBLES
    ),
    "Q26_double_down_worn_at_6": on_facts(
        f"SELECT * FROM ({_advised('6')}) WHERE ceo_recommendation = 'Double Down'", _CELL_DOUBLES
    ),
    "Q27_avg_frequency_by_platform": on_facts(
        per("platform", {"avg_frequency": mean("frequency", 2)}), "avg_frequency"
    ),
    "Q28_distinct_frequency": on_facts(
        "SELECT DISTINCT frequency FROM facts ORDER BY frequency LIMIT 20", "frequency"
    ),
    "Q29_total_reach": on_facts("SELECT sum(reach) AS total_reach FROM facts", "", "total_reach"),
}
# The same figures, whichever tables they come from.
QUESTIONS["Q2_over_star"] = QUESTIONS["Q2_reach_by_platform"]
