import datetime as dt
from decimal import Decimal as D

from hand import facts_rows
from spendlens.plans import kpis, trends


def quarters(*roas):
    """One campaign per quarter from 2023-Q1 on."""
    return [
        {"date": dt.date(2023 + i // 4, 3 * (i % 4) + 1, 1), "roas": r} for i, r in enumerate(roas) if r is not None
    ]


def test_month_gap_and_zero_are_blank(spark):
    months = {1: "10.00", 2: "15.00", 5: "0.00", 6: "5.00"}
    rows = facts_rows(spark, *[{"date": dt.date(2024, m, 9), "spend": s} for m, s in months.items()])
    found = [(r.year_month[-2:], r.value, r.change, r.change_pct) for r in trends.mom(rows, "total_spend").collect()]
    assert found == [
        ("01", D("10.00"), None, None),
        ("02", D("15.00"), D("5.00"), D("50.00")),
        ("03", None, None, None),
        ("04", None, None, None),
        ("05", D("0.00"), None, None),
        ("06", D("5.00"), D("5.00"), None),
    ]


def test_year_without_predecessor_has_no_change(spark):
    years = {2021: "0.1000", 2022: "0.2000", 2024: "0.3000"}
    rows = facts_rows(spark, *[{"date": dt.date(y, 1, 1), "hook_rate": h} for y, h in years.items()])
    found = [(r.year, r.change, r.change_pct) for r in trends.yoy(rows, "hook_rate").collect()]
    assert found == [(2021, None, None), (2022, D("0.1000"), D("100.00")), (2024, None, None)]


def test_longest_decline(spark):
    falling = quarters("9", "8", "7", "8", "7", "6", "5", "5")
    flat = [{**r, "platform": "Google"} for r in quarters("3", "3", "4")]
    rows = trends.decline_streak(facts_rows(spark, *falling, *flat)).collect()
    assert rows == [("Google", 0, 0, None, None), ("Meta", 3, 4, "2023-Q4", "2024-Q3")]


def test_earliest_of_equal_declines(spark):
    rows = facts_rows(spark, *quarters("9", "8", "9", "8"))
    assert trends.decline_streak(rows).first() == ("Meta", 1, 2, "2023-Q1", "2023-Q2")


def test_first_quarter_below_breakeven(spark):
    rows = facts_rows(spark, *quarters("5", "4", "3.9990", "5"), {"platform": "Google"})
    found = {r.platform: (r.first_quarter_below, r.quarters_below) for r in trends.breakeven_crossing(rows).collect()}
    assert found == {"Meta": ("2023-Q3", 1), "Google": (None, 0)}
    assert [r.roas_change for r in trends.quarter_trend(rows.filter("platform = 'Meta'")).collect()][:2] == [None, D("-1.00")]


def test_refresh_due_looks_at_the_last_day(spark):
    def seen(ad, day, score):
        return {"ad_id": ad, "date": dt.date(2024, 1, day), "fatigue_score": score}

    rows = facts_rows(
        spark, seen("due", 1, "1.0"), seen("due", 2, "3.5"), seen("due", 2, "2.0"), seen("fresh", 2, "3.4"),
        seen("worn", 1, "3.9"), seen("worn", 3, "4.0"),
    )
    found = kpis.refresh_due(rows).collect()
    assert [(r.ad_id, r.last_date.day, r.fatigue_score, r.headroom) for r in found] == [("due", 2, D("3.5"), D("0.5"))]


def test_cells_flip_by_fatigue_filter(spark):
    rows = facts_rows(
        spark,
        {"fatigue_status": "Low Fatigue", "fatigue_score": "2.0", "roas": "3.0000"},
        {"fatigue_status": "High Fatigue", "fatigue_score": "9.0", "roas": "1.0000"},
    )
    assert kpis.scale_matrix(rows).first().scalability_decision == "Kill"
    assert kpis.scale_matrix(rows, fatigue_status="Low Fatigue").first().scalability_decision == "Optimise"


def test_shares_within_groups(spark):
    rows = facts_rows(spark, {}, {}, {"performance_category": "Illusion"}, {"platform": "Google"})
    found = kpis.category_share(rows, "performance_category", ["platform"]).collect()
    assert [(r.platform, r.share_pct) for r in found] == [
        ("Google", D("100.00")), ("Meta", D("66.67")), ("Meta", D("33.33")),
    ]
