"""Branches, NULL order, ties and empty inputs that the bound tables do not reach."""

from decimal import Decimal as D

import pytest

from hand import facts_rows
from spendlens.plans import attention, awareness, decision, efficiency, interest, kpis, profit


def column(df, name):
    return [r[name] for r in df.collect()]


def test_spend_verdict_shares_and_both_labels(spark):
    df = awareness.spend_verdict(facts_rows(spark, {"spend": "30.00"}, {"platform": "Google", "roas": "3.9900"}))
    rows = df.collect()
    assert [(r.platform, r.spend_share_pct, r.spend_verdict) for r in rows] == [
        ("Meta", D("75.00"), "Spend Justified"),
        ("Google", D("25.00"), "Spend Not Justified"),
    ]
    assert rows[1].roas_vs_breakeven_gap == D("-0.01")


def test_null_sort_keys_come_first_descending_and_last_ascending(spark):
    rows = facts_rows(
        spark, {"impressions": 0, "clicks": 0}, {"platform": "Google"}, {"hook_type": "Shock", "hook_rate": None}
    )
    zero = interest.funnel_leak(rows.filter("impressions = 0"), flag_nulls=True).first()
    assert zero.overall_funnel_pct is None and zero.funnel_diagnosis == "Funnel Healthy"
    assert zero.funnel_diagnosis_is_null_input
    assert column(interest.click_quality(rows.filter("impressions = 0 or platform = 'Google'")), "platform") == [
        "Meta", "Google",
    ]
    both = interest.funnel_leak(rows.filter("impressions = 0 or platform = 'Google'"))
    assert column(both, "platform") == ["Google", "Meta"]
    stoppers = attention.scroll_stoppers(rows, min_ads=1)
    assert column(stoppers, "avg_hook_rate")[0] is None
    assert column(attention.scroll_stoppers(rows, min_ads=1, k=1), "hook_type") == ["Shock"]


def test_audience_quality_puts_null_first_before_its_limit(spark):
    rows = facts_rows(spark, {"ctr": "0.9000"}, {"hook_type": "Shock", "ctr": None}, {"hook_type": "Question", "ctr": "0.0100"})
    assert column(interest.audience_quality(rows, min_ads=1), "hook_type") == ["Shock", "Story", "Question"]
    assert column(interest.audience_quality(rows, min_ads=1, k=1), "avg_ctr") == [None]


def test_ugc_effect_counts_rows_on_neither_side(spark):
    rows = facts_rows(spark, {}, {"has_ugc": None}, {"has_ugc": 7}, {"has_ugc": 0, "roas": "2.0000"}, {"platform": "Google"})
    sides = {r.platform: r for r in kpis.ugc_effect(rows).collect()}
    meta, google = sides["Meta"], sides["Google"]
    assert (meta.campaigns_with_ugc, meta.campaigns_without_ugc, meta.campaigns_of_unknown_ugc) == (1, 1, 2)
    assert meta.roas_difference == D("5.0000")
    assert (google.campaigns_without_ugc, google.campaigns_of_unknown_ugc, google.roas_difference) == (0, 0, None)


def test_having_counts_ads(spark):
    rows = facts_rows(spark, {}, {}, {"copy_tone": "Urgent"})
    assert column(attention.scroll_stoppers(rows, min_ads=2), "copy_tone") == ["Casual"]
    assert interest.audience_quality(rows, min_ads=4).count() == 0


def test_attention_traps_need_both_conditions_on_unrounded_means(spark):
    rows = facts_rows(
        spark,
        {"ad_id": "A", "hook_rate": "0.1801"},
        {"ad_id": "B", "hook_rate": "0.1800"},
        {"ad_id": "C", "completion_rate": "0.0500"},
        {"ad_id": "D", "hook_rate": None},
    )
    traps = attention.attention_traps(rows)
    assert column(traps, "ad_id") == ["A"]
    assert attention.attention_trap_retention(traps).first().retention_ratio == D("0.2221")
    spent = attention.attention_trap_spend(traps).first()
    assert (spent.trap_count, spent.spend_on_traps) == (1, D("10.00"))
    none = attention.attention_trap_spend(attention.attention_traps(rows, hook=0.9)).first()
    assert (none.trap_count, none.spend_on_traps) == (0, None)


def test_click_traps_use_rounded_means_and_a_minimum(spark):
    trap = {"ctr": "0.0400", "cvr": "0.0100"}
    rows = facts_rows(spark, *[trap] * 5, *[{**trap, "ad_id": "CR-002"}] * 4, *[{"ad_id": "CR-003", "cvr": "0.0200"}] * 5)
    traps = interest.click_traps(rows)
    assert column(traps, "ad_id") == ["CR-001"]
    assert column(traps, "creative_diagnosis") == ["Click Trap attracting wrong audience"]
    assert interest.click_trap_waste(traps).first() == (1, D("50.00"))


def test_funnel_problems(spark):
    rows = facts_rows(spark, {"clicks": 19}, {"platform": "Google", "clicks": 100}, {"platform": "TikTok"})
    found = {r.platform: r.funnel_diagnosis for r in interest.funnel_leak(rows).collect()}
    assert found == {
        "Meta": "Traffic Problem — low CTR before click",
        "Google": "Conversion Problem — low CVR after click",
        "TikTok": "Funnel Healthy",
    }


def test_fatigue_steps_as_written_and_per_ad(spark):
    low, mid = "1.0", "5.0"
    rows = facts_rows(
        spark,
        {"ad_id": "A", "fatigue_score": low, "roas": "8.0000"},
        {"ad_id": "B", "fatigue_score": low, "roas": "5.0000"},
        {"ad_id": "A", "fatigue_score": mid, "roas": "2.0000"},
        {"ad_id": "B", "fatigue_score": mid, "roas": None},
        {"ad_id": "C", "fatigue_score": mid, "product": "Yoga Mat", "roas": "1.0000"},
        {"ad_id": "A", "platform": "Google", "fatigue_score": mid, "roas": "4.0000"},
    )
    as_written = column(efficiency.fatigue_bands(rows), "roas_change_vs_prev_band")
    assert as_written == [None, None, D("-3.00"), D("-3.00"), None, None]
    per_ad = column(efficiency.fatigue_bands(rows, per_ad=True), "roas_change_vs_prev_band")
    assert per_ad == [None, None, None, D("-6.00"), None, None]


def test_scalability_order_is_decision_then_spend(spark):
    rows = facts_rows(
        spark,
        {"ad_id": "kill", "roas": "1.0000", "fatigue_status": "High Fatigue", "spend": "99.00"},
        {"ad_id": "optimise", "roas": "1.0000"},
        {"ad_id": "monitor", "fatigue_status": "Medium Fatigue"},
        {"ad_id": "scale_small", "spend": "1.00"},
        {"ad_id": "scale_none", "spend": None},
        {"ad_id": "scale"},
    )
    assert column(efficiency.scalability_matrix(rows), "ad_id") == [
        "scale_none", "scale", "scale_small", "monitor", "optimise", "kill",
    ]


def test_margin_labels_at_the_cuts(spark):
    def cell(product, margin, net):
        return {"product": product, "contribution_margin": margin, "net_revenue": net}

    rows = facts_rows(
        spark,
        cell("thin", "14.99", "100.00"),
        cell("moderate", "0.54", "3.60"),  # exactly 0.15
        cell("healthy", "30.00", "100.00"),
        cell("none", "0.00", "0.00"),
    )
    health = {r["product"]: r for r in profit.contribution_by_product(rows, flag_nulls=True).collect()}
    assert health["thin"].margin_health == "Danger — Thin Margin"
    assert health["moderate"].margin_health == "Moderate — Monitor"
    assert health["healthy"].margin_health == "Healthy Margin"
    assert health["none"].margin_health == "Healthy Margin" and health["none"].margin_health_is_null_input
    illusion = {r["product"]: r.margin_verdict for r in profit.margin_illusion(rows).collect()}
    assert illusion["thin"] == "Margin Illusion — thin margin warning"
    assert illusion["moderate"] == "Moderate Margin — monitor closely"


def test_platform_efficiency_labels(spark):
    rows = facts_rows(
        spark,
        {"platform": "a", "contribution_margin": "5.00"},
        {"platform": "b", "contribution_margin": "2.00"},
        {"platform": "c", "contribution_margin": "1.99"},
        {"platform": "d", "spend": "0.00"},
    )
    found = {r.platform: r.platform_efficiency for r in profit.contribution_per_spend(rows).collect()}
    assert found == {
        "a": "Efficient Platform", "b": "Moderate Platform", "c": "Inefficient Platform", "d": "Inefficient Platform",
    }
    assert profit.contribution_per_spend(rows).first().platform == "d"


def test_breakeven_verdicts(spark):
    rows = facts_rows(
        spark,
        *[{"platform": p, "roas": r} for p, r in zip("abcd", ("4.8000", "4.7000", "1.5000", "1.4000"))],
        {"platform": "e", "roas": None},
    )
    found = {r.platform: r for r in profit.breakeven_illusion(rows).collect()}
    assert [found[p].profitability_verdict for p in "abcde"] == [
        "Genuinely Profitable", "Barely Breaking Even", "Illusion — Losing Money", "Obvious Loss", "Obvious Loss",
    ]
    assert [found[p].loss_making_campaigns for p in "abcde"] == [0, 0, 1, 1, 0]
    assert found["d"].spend_below_breakeven == D("10.00") and found["e"].spend_below_breakeven == 0


def test_budget_branches_and_double_down(spark):
    def cell(platform, profit_, roas, fatigue):
        return {"platform": platform, "net_profit": profit_, "roas": roas, "fatigue_score": fatigue}

    rows = facts_rows(
        spark,
        cell("down", "5.00", "4.8000", "4.9"),
        cell("maintain", "5.00", "1.0000", "5.0"),
        cell("optimise", "0.00", "3.6000", "9.0"),
        cell("weak", "5.00", "4.7900", "1.0"),
        cell("lost", "-5.00", "3.5000", "1.0"),
    )
    found = [(r.platform, r.ceo_recommendation) for r in decision.budget_recommendation(rows).collect()]
    assert found == [
        ("down", "Double Down"), ("maintain", "Maintain"), ("optimise", "Optimise"),
        ("weak", "Deprioritise"), ("lost", "Deprioritise"),
    ]
    assert column(decision.double_down(rows), "platform") == ["down"]


def test_category_order_and_waste(spark):
    names = ("Obvious Loser", "Illusion", "Break-Even", "Genuine Winner", "Extreme Winner")
    rows = facts_rows(spark, *[{"performance_category": n} for n in names])
    assert column(decision.category_spend(rows), "performance_category") == list(reversed(names))
    assert decision.wasted_spend(rows).first() == (D("20.00"), D("40.00"))
    assert decision.wasted_spend(rows.filter("false")).first() == (None, None)


def test_invariants_on_bound_tables(facts):
    total = facts.agg({"spend": "sum"}).first()[0]
    assert sum(column(awareness.reach_by_platform(facts), "total_spend")) == total
    assert sum(column(efficiency.scalability_matrix(facts), "total_spend")) == total
    shares = column(awareness.spend_verdict(facts), "spend_share_pct")
    assert abs(sum(shares) - 100) < D("0.2")
    leak = profit.quarterly_leakage(facts).collect()
    assert all(r.total_gross - r.total_discounts - r.total_refunds == r.total_net for r in leak)
    bands = efficiency.fatigue_bands(facts).count()
    assert bands == facts.selectExpr("platform", "product", "ad_id", "least(int(fatigue_score / 2), 4)").distinct().count()


@pytest.mark.parametrize("choice, n", [({"year": 2024}, 2), ({"platform": ["Meta", "Google"], "month": 1}, 1), ({}, 3)])
def test_slicers(spark, choice, n):
    import datetime as dt

    rows = facts_rows(spark, {}, {"date": dt.date(2024, 2, 1)}, {"date": dt.date(2023, 1, 1), "platform": "TikTok"})
    assert kpis.slice_by(rows, **choice).count() == n
    assert kpis.kpis(rows, filters=choice).first().campaigns == n
