"""DuckDB formulation of the KPI and trend operators."""

from __future__ import annotations

from .prelude import on_facts, ratio, rnd
from .questions import PAIR, mean, per, scale_label, share, total

MEASURES = {
    "campaigns": "count(*)",
    "total_spend": total("spend"),
    "gross_revenue": total("gross_revenue"),
    "net_revenue": total("net_revenue"),
    "total_purchases": "sum(purchases)",
    "avg_fatigue_score": mean("fatigue_score", 2),
    "cost_per_unique_reach": rnd(ratio("sum(spend)", "sum(reach)"), 4),
    "hook_rate": mean("hook_rate", 4),
    "hold_rate": mean("hold_rate_3s", 4),
    "completion_rate": mean("completion_rate", 4),
    "ctr": rnd(ratio("sum(clicks)", "sum(impressions)"), 4),
    "cvr": rnd(ratio("sum(purchases)", "sum(clicks)"), 4),
    "mean_roas": mean("roas", 4),
    "net_blended_roas": rnd(ratio("sum(net_revenue)", "sum(spend)"), 4),
    "gross_blended_roas": rnd(ratio("sum(gross_revenue)", "sum(spend)"), 4),
    "breakeven_roas": mean("breakeven_roas", 4),
}
_KPI_DOUBLES = " ".join(m for m in MEASURES if m not in ("campaigns", "total_purchases"))
_DECISION = scale_label("roas", "breakeven_roas", "fatigue_status")


def _kpis(grain: str, where: str = "true") -> str:
    body = per(grain, MEASURES).replace("FROM facts", f"FROM facts WHERE {where}")
    return on_facts(body, _KPI_DOUBLES, "total_purchases")


def _category_share(column: str, expression: str, by: str = "") -> str:
    lead, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return on_facts(
        f"SELECT *, {rnd(f'campaigns / sum(campaigns) OVER ({part}) * 100', 2)} AS share_pct FROM ("
        f"SELECT {lead}{expression} AS {column}, count(*) AS campaigns FROM facts GROUP BY ALL)",
        "share_pct",
    )


def _scale_cells(where: str = "true", roas: str = "avg(roas)") -> str:
    status = "CASE WHEN f < 4 THEN 'Low Fatigue' WHEN f < 7 THEN 'Medium Fatigue' ELSE 'High Fatigue' END"
    return on_facts(
        f"SELECT product, platform, campaigns, {rnd('f', 2)} AS avg_fatigue, cell_status, {rnd('r', 2)} AS roas, "
        f"{rnd('b', 2)} AS breakeven, {scale_label('r', 'b', 'cell_status')} AS scalability_decision FROM ("
        f"SELECT *, {status} AS cell_status FROM (SELECT product, platform, count(*) AS campaigns, "
        f"avg(fatigue_score) AS f, {roas} AS r, avg(breakeven_roas) AS b FROM facts WHERE {where} "
        "GROUP BY product, platform))",
        "avg_fatigue roas breakeven",
    )


def _ugc() -> str:
    sides = {"without": "has_ugc = 0", "with": "has_ugc = 1"}
    parts = [f"count(*) FILTER (WHERE {c}) AS campaigns_{side}_ugc" for side, c in sides.items()]
    parts.append("count(*) FILTER (WHERE coalesce(has_ugc, -1) NOT IN (0, 1)) AS campaigns_of_unknown_ugc")
    outer = []
    for name, column in {"hook": "hook_rate", "completion": "completion_rate", "roas": "roas"}.items():
        for side, c in sides.items():
            parts.append(f"{rnd(f'avg({column}) FILTER (WHERE {c})', 4)} AS {name}_{side}_ugc")
        outer.append(f"{name}_with_ugc - {name}_without_ugc AS {name}_difference")
    doubles = " ".join(f"{n}_{k}" for n in ("hook", "completion", "roas") for k in ("without_ugc", "with_ugc", "difference"))
    return on_facts(
        f"SELECT *, {', '.join(outer)} FROM (SELECT platform, ad_format, {', '.join(parts)} FROM facts "
        "GROUP BY platform, ad_format)",
        doubles,
    )


def _only(platform: str) -> str:
    return f"FILTER (WHERE platform = '{platform}')"


def _changes(previous: str) -> str:
    return (
        f"{previous} AS previous_value, value - {previous} AS change, "
        f"{rnd(ratio(f'(value - {previous})', previous) + ' * 100', 2)} AS change_pct"
    )


def _mom(measure: str, by: str, where: str = "true") -> str:
    """Dense months: a spine of all months of each group, left joined to the monthly values."""
    return on_facts(
        f"WITH monthly AS (SELECT {by}, date_trunc('month', date) AS m, {MEASURES[measure]} AS value FROM facts "
        f"WHERE {where} GROUP BY {by}, date_trunc('month', date)), "
        f"spine AS (SELECT {by}, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM monthly "
        f"GROUP BY {by}), dense AS (SELECT spine.*, value FROM spine LEFT JOIN monthly USING ({by}, m)), "
        f"stepped AS (SELECT *, lag(value) OVER (PARTITION BY {by} ORDER BY m) AS p FROM dense) "
        f"SELECT {by}, strftime(m, '%Y-%m') AS year_month, value, {_changes('p')} FROM stepped",
        "value previous_value change change_pct",
    )


def _yoy(measure: str, by: str) -> str:
    return on_facts(
        f"WITH yearly AS (SELECT {by}, year, {MEASURES[measure]} AS value FROM facts GROUP BY {by}, year), "
        f"paired AS (SELECT y.*, p.value AS p FROM yearly y LEFT JOIN yearly p ON y.{by} = p.{by} "
        f"AND y.year = p.year + 1) SELECT {by}, year, value, {_changes('p')} FROM paired",
        "value previous_value change change_pct",
    )


_QUARTERLY = (
    "SELECT platform, year_quarter, "
    + ", ".join(f"{e} AS {a}" for a, e in PAIR.items())
    + f", {rnd('avg(roas) - avg(breakeven_roas)', 2)} AS gap, avg(roas) < avg(breakeven_roas) AS below "
    "FROM facts GROUP BY platform, year_quarter"
)
# Runs of falling quarters by comparing each quarter's number with its number among the falls.
_STREAK = f"""WITH quarters AS ({_QUARTERLY}), steps AS (
  SELECT platform, year_quarter, row_number() OVER w AS n, lag(year_quarter) OVER w AS from_quarter,
         coalesce(avg_roas < lag(avg_roas) OVER w, false) AS fell
  FROM quarters WINDOW w AS (PARTITION BY platform ORDER BY year_quarter)
), islands AS (
  SELECT *, n - row_number() OVER (PARTITION BY platform ORDER BY year_quarter) AS island FROM steps WHERE fell
), runs AS (
  SELECT platform, count(*) AS declines, min(from_quarter) AS from_quarter, max(year_quarter) AS to_quarter
  FROM islands GROUP BY platform, island
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY platform ORDER BY declines DESC, from_quarter) = 1
)
SELECT p.platform, coalesce(declines, 0) AS declines, coalesce(declines + 1, 0) AS quarters, from_quarter, to_quarter
FROM (SELECT DISTINCT platform FROM quarters) p LEFT JOIN best USING (platform)"""

_REFRESH = """WITH last_days AS (SELECT platform, product, ad_id, max(date) AS last_date FROM facts GROUP BY ALL)
SELECT platform, product, ad_id, last_date, max(fatigue_score) AS fatigue_score, 4 - max(fatigue_score) AS headroom
FROM facts JOIN last_days USING (platform, product, ad_id) WHERE date = last_date
GROUP BY platform, product, ad_id, last_date HAVING max(fatigue_score) BETWEEN 3.5 AND 3.9999"""

DASHBOARD: dict[str, str] = {
    "K1_kpis": _kpis(""),
    "K1_kpis_by_platform": _kpis("platform"),
    "K2_slice": _kpis(
        "product",
        "year IN (1996, 1997) AND month_number = 3 AND platform = 'TikTok' AND ad_format = 'Video' "
        "AND fatigue_status = 'Low Fatigue'",
    ),
    "K2_over_master": _kpis("product", "year = 1997"),
    "K3_category_share": _category_share("performance_category", "performance_category"),
    "K3_decision_share_by_year": _category_share("scalability_decision", _DECISION, "year"),
    "K4_awareness": on_facts(
        per(
            "platform",
            {
                "total_reach": "sum(reach)",
                "avg_frequency": mean("frequency", 2),
                "cost_per_unique_reach": MEASURES["cost_per_unique_reach"],
                "avg_cpm": mean("cpm", 2),
            },
        ),
        "avg_frequency cost_per_unique_reach avg_cpm",
        "total_reach",
    ),
    "K5_attention_funnel": on_facts(
        "SELECT platform, year, "
        + ", ".join(
            [
                f"{rnd('h', 4)} AS hook_rate, {rnd('s', 4)} AS hold_rate, {rnd('c', 4)} AS completion_rate",
                f"{rnd(ratio('s', 'h'), 4)} AS hook_to_hold, {rnd(ratio('c', 's'), 4)} AS hold_to_completion",
                f"{rnd('1 - ' + ratio('c', 'h'), 4)} AS dropoff_share",
            ]
        )
        + " FROM (SELECT platform, year, avg(hook_rate) AS h, avg(hold_rate_3s) AS s, avg(completion_rate) AS c "
        "FROM facts GROUP BY platform, year)",
        "hook_rate hold_rate completion_rate hook_to_hold hold_to_completion dropoff_share",
    ),
    "K6_ugc_effect": _ugc(),
    "K7_acquisition_cost": on_facts(
        per(
            "product, platform",
            {
                "total_spend": total("spend"),
                "total_purchases": "sum(purchases)",
                "cost_per_acquisition": rnd(ratio("sum(spend)", "sum(purchases)"), 2),
                "mean_cpa": mean("cpa", 2),
                "ctr": MEASURES["ctr"],
                "cvr": MEASURES["cvr"],
            },
        ),
        "total_spend cost_per_acquisition mean_cpa ctr cvr",
        "total_purchases",
    ),
    "K8_scale_matrix": _scale_cells(),
    "K8_scale_matrix_low_fatigue": _scale_cells("fatigue_status = 'Low Fatigue'", ratio("sum(net_revenue)", "sum(spend)")),
    "K9_roas_by_fatigue": on_facts(
        per(
            "fatigue_status",
            {
                "campaigns": "count(*)",
                "mean_roas": mean("roas", 2),
                "net_blended_roas": rnd(ratio("sum(net_revenue)", "sum(spend)"), 2),
                "breakeven": mean("breakeven_roas", 2),
                "roas_vs_breakeven_gap": rnd("avg(roas) - avg(breakeven_roas)", 2),
            },
        ),
        "mean_roas net_blended_roas breakeven roas_vs_breakeven_gap",
    ),
    "K10_breakeven_gap_matrix": on_facts(
        "SELECT product, "
        + ", ".join(
            rnd(f"avg(roas) {_only(p)} - avg(breakeven_roas) {_only(p)}", 2) + f" AS gap_{p.lower()}"
            for p in ("Meta", "TikTok", "YouTube", "Google")
        )
        + ", " + rnd("avg(roas - breakeven_roas) FILTER (WHERE platform NOT IN ('Meta', 'TikTok', 'YouTube', 'Google'))", 2)
        + " AS gap_other FROM facts GROUP BY product",
        "gap_meta gap_tiktok gap_youtube gap_google gap_other",
    ),
    "K11_never_break_even_spend": on_facts(
        "SELECT round(sum(if(performance_category IN ('Obvious Loser', 'Illusion'), spend, 0)), 2) AS wasted_spend, "
        + share("sum(if(performance_category IN ('Obvious Loser', 'Illusion'), spend, 0))", "sum(spend)")
        + " AS wasted_spend_pct FROM facts",
        "wasted_spend wasted_spend_pct",
    ),
    "K12_breakeven_table": on_facts(
        f"SELECT DISTINCT product, {rnd(ratio('selling_price', '(selling_price - product_cost)'), 4)} AS breakeven_roas "
        "FROM facts",
        "breakeven_roas",
    ),
    "T1_mom": _mom("total_spend", "platform"),
    "T1_mom_with_gaps": _mom("mean_roas", "ad_id, platform, product"),
    "T2_yoy": _yoy("hook_rate", "platform"),
    "T3_quarter_trend": on_facts(
        "SELECT platform, year_quarter, avg_roas, avg_breakeven, gap, avg_roas - lag(avg_roas) OVER "
        f"(PARTITION BY platform ORDER BY year_quarter) AS roas_change FROM ({_QUARTERLY})",
        "avg_roas avg_breakeven gap roas_change",
    ),
    "T4_decline_streak": on_facts(_STREAK),
    "T5_breakeven_crossing": on_facts(
        "SELECT platform, min(year_quarter) FILTER (WHERE below) AS first_quarter_below, "
        "count(*) FILTER (WHERE below) AS quarters_below, count(*) AS quarters "
        f"FROM ({_QUARTERLY}) GROUP BY platform"
    ),
    "T6_refresh_due": on_facts(_REFRESH, "fatigue_score headroom", texts="last_date"),
}

# The operators over the rollup give the figures of those over the facts.
DASHBOARD |= {
    f"{name.split('_')[0]}_from_rollup": DASHBOARD[name]
    for name in (
        "K1_kpis_by_platform", "K2_slice", "K4_awareness", "K5_attention_funnel", "K7_acquisition_cost", "K8_scale_matrix",
        "K9_roas_by_fatigue", "K10_breakeven_gap_matrix", "T1_mom", "T2_yoy", "T3_quarter_trend", "T4_decline_streak",
        "T5_breakeven_crossing",
    )
}
DASHBOARD["T6_leaving_low_fatigue"] = on_facts(
    "WITH fitted AS (SELECT platform, product, ad_id, count(*) AS scored_rows, max(date) AS last_date, "
    "CASE WHEN min(date) < max(date) THEN regr_slope(cast(fatigue_score AS double), date - DATE '1970-01-01') END AS s, "
    "regr_intercept(cast(fatigue_score AS double), date - DATE '1970-01-01') AS i FROM facts GROUP BY ALL), "
    "crossed AS (SELECT *, CASE WHEN s > 0 AND (4 - i) / s BETWEEN -719162 AND 2932896 THEN cast(ceil(round((4 - i) / s, 6)) AS int) END AS day FROM fitted) "
    f"SELECT platform, product, ad_id, scored_rows, last_date, {rnd('s', 6)} AS slope, DATE '1970-01-01' + day AS crossing_day, "
    "cast(day - (last_date - DATE '1970-01-01') AS bigint) AS days_left FROM crossed",
    "slope", texts="last_date crossing_day",
)
