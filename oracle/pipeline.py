"""DuckDB formulation of sources, cleaning, modelling and the master data sets."""

from __future__ import annotations

from .prelude import CALCULATED_LIST, DECIMALS, RAW_LIST, calendar, on_facts, on_raw, plain, ratio, rnd
from .questions import _TRAPS, _TRAP_DOUBLES, advice_label, profit_label, scale_label, share

_CALENDAR_NAMES = [
    "day_of_week", "week_number", "month_number", "month_name", "quarter", "quarter_label", "year", "year_quarter",
    "year_month", "is_weekend",
]
_CREATIVE = RAW_LIST[:12]
_PERFORMANCE = [
    "row_id", "impressions", "reach", "frequency", "fatigue_score", "fatigue_status", "creative_score", "hook_rate",
    "hold_rate_3s", "completion_rate", "funnel_dropoff_rate", "spend", "cpm", "clicks", "ctr", "cpc", "purchases",
    "cvr", "cpa",
]
_REVENUE = [
    "row_id", "gross_revenue", "discount_amount", "refund_amount", "net_revenue", "roas", "breakeven_roas",
    "contribution_margin", "fixed_cost_allocation", "net_profit", "performance_category",
]
_PRODUCT = ["selling_price", "product_cost", "gross_margin_pct"]
_CATEGORIES = ["platform", "product", "hook_type", "creative_angle", "copy_tone", "ad_format", "has_ugc"]
_LONGS = ["impressions", "reach", "clicks", "purchases"]
_NUMBERS = [c for c in RAW_LIST if c in DECIMALS or c in _LONGS]
_CLEAN = "SELECT * FROM raw WHERE NOT ends_with(row_id, '_dup')"


def _take(names: list[str], source: str = "facts") -> str:
    return f"SELECT {', '.join(names)} FROM {source}"


def _numbered(prefix: str, key: str, names: list[str], source: str = "facts") -> str:
    """Rows with a generated key in the order of ``row_id``; numbers past six digits are written in full."""
    number = "row_number() OVER (ORDER BY row_id)"
    return f"SELECT format('{prefix}{{:06d}}', {number}) AS {key}, {', '.join(names)} FROM {source}"


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _spelled(column: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN '{v.lower()}' THEN '{v}'" for v in values)
    return f"CASE lower(trim({column})) {cases} ELSE {column} END"


_PLATFORMS = ["Meta", "TikTok", "YouTube", "Google"]
_PRODUCTS = [
    "Whey Protein", "Creatine", "Pre-Workout", "Protein Bars", "Resistance Bands", "Foam Roller", "Dumbbells",
    "Yoga Mat",
]


def _mean_filled(column: str) -> str:
    average = f"(SELECT {rnd(f'avg({column})', 4)} FROM deduplicated)"
    return f"coalesce({column}, cast({average} AS decimal(8,4)))"


_FILLED = (
    f"WITH deduplicated AS ({_CLEAN}) SELECT * REPLACE ({_mean_filled('hook_rate')} AS hook_rate, "
    f"{_mean_filled('completion_rate')} AS completion_rate), hook_rate IS NULL AS hook_rate_imputed, "
    "completion_rate IS NULL AS completion_rate_imputed FROM deduplicated"
)

_RULES = {
    **{f"{c}_in_0_1": f"{c} >= 0 AND {c} <= 1" for c in ("hook_rate", "hold_rate_3s", "completion_rate", "ctr", "cvr")},
    **{
        f"{c}_not_negative": f"{c} >= 0"
        for c in ("spend", "gross_revenue", "discount_amount", "refund_amount", "net_revenue")
    },
    "roas_below_max": "roas < 10",
    "frequency_at_least_1": "frequency >= 1",
    "hook_rate_max": "hook_rate <= 0.4",
    "hold_below_hook": "hold_rate_3s < hook_rate",
    "completion_below_hold": "completion_rate < hold_rate_3s",
}
_IDENTITIES = {
    "frequency": ratio("impressions", "reach"),
    "gross_margin_pct": ratio("selling_price - product_cost", "selling_price"),
    "cpm": ratio("spend * 1000", "impressions"),
    "ctr": ratio("clicks", "impressions"),
    "cpc": ratio("spend", "clicks"),
    "cvr": ratio("purchases", "clicks"),
    "cpa": ratio("spend", "purchases"),
    "gross_revenue": "cast(purchases * selling_price AS double)",
    "net_revenue": "cast(gross_revenue - discount_amount - refund_amount AS double)",
    "roas": ratio("net_revenue", "spend"),
}


def _identity(name: str, formula: str) -> str:
    gap = f"abs(cast({name} AS double) - {formula})"
    return (
        f"SELECT '{name}' AS \"identity\", count({gap}) AS checked_rows, "
        f"count(*) FILTER (WHERE {rnd(gap, 8)} > 0.01) AS mismatches, "
        f"count(*) FILTER (WHERE ({name} IS NULL) <> ({formula} IS NULL)) AS one_sided_nulls, "
        f"{rnd(f'max({gap})', 6)} AS largest_gap FROM clean_rows"
    )


def _violated() -> str:
    listed = ", ".join(f"CASE WHEN NOT ({cond}) THEN '{name}' END" for name, cond in _RULES.items())
    return (
        f"SELECT row_id, broken_rules FROM (SELECT row_id, concat_ws(',', {listed}) AS broken_rules FROM ({_FILLED})) "
        "WHERE broken_rules <> ''"
    )


# The five tables and their inner joins, as the views read them.
_STAR = (
    f"WITH ad_creative AS ({_take(_CREATIVE)}), ad_performance AS ({_take(_PERFORMANCE)}), "
    f"revenue AS ({_take(_REVENUE)}), "
    f"products AS (SELECT DISTINCT product, {', '.join(_PRODUCT)} FROM facts), "
    f"dim_date AS (SELECT DISTINCT date, {', '.join(_CALENDAR_NAMES)} FROM facts) "
)
_JOINED = (
    "FROM revenue JOIN ad_performance USING (row_id) JOIN ad_creative USING (row_id) "
    "JOIN products USING (product) JOIN dim_date USING (date)"
)
_PERFORMANCE_MASTER = [
    "row_id", "campaign_id", "campaign_name", "ad_id", "date", *_CALENDAR_NAMES, *_CATEGORIES, *_PRODUCT,
    *_PERFORMANCE[1:], "gross_revenue", "net_revenue", "roas", "breakeven_roas", "performance_category",
]
_PROFIT_MASTER = [
    "row_id", "ad_id", "date", "month_name", "month_number", "quarter", "quarter_label", "year", "year_quarter",
    "year_month", "platform", "product", *_PRODUCT, "spend", "purchases", "fatigue_score", "fatigue_status",
    *_REVENUE[1:],
]
_DECISION = scale_label("roas", "breakeven_roas", "fatigue_status")
_COMBINATION = (
    "hook_type || ' | ' || creative_angle || ' | ' || copy_tone || ' | ' || ad_format || ' | ' || "
    "CASE has_ugc WHEN 1 THEN 'UGC' ELSE 'Non UGC' END"
)
_PROFIT_STATUS = profit_label("net_profit")
_ADVICE = advice_label("net_profit", "roas", "breakeven_roas", "fatigue_score")
_LEAKS = {
    "discount_leakage_pct": share("discount_amount", "gross_revenue"),
    "refund_leakage_pct": share("refund_amount", "gross_revenue"),
    "revenue_retention_pct": share("net_revenue", "gross_revenue"),
}
_LEAK_LIST = ", ".join(f"{e} AS {n}" for n, e in _LEAKS.items())
_GAP = "round(roas - breakeven_roas, 2)"
_FATIGUE = "CASE WHEN fatigue_score < 4 THEN 'Low Fatigue' WHEN fatigue_score < 7 THEN 'Medium Fatigue' ELSE 'High Fatigue' END"


def _calculated(name: str, formula: str) -> str:
    return on_raw(f"SELECT row_id, {formula} AS {name} FROM ({_CLEAN})", name if name in DECIMALS else "")


def _decisions(name: str, formula: str, doubles: str = "") -> str:
    return on_facts(f"SELECT row_id, {formula} AS {name} FROM facts", doubles)


_BREAKEVEN = rnd(ratio("selling_price", "(selling_price - product_cost)"), 4)
_FLAT_NAMES = RAW_LIST + CALCULATED_LIST
_FLAT_FROM_RAW = (
    f"SELECT {', '.join(RAW_LIST)}, b AS breakeven_roas, net_revenue - product_cost * purchases AS contribution_margin, "
    "net_revenue - product_cost * purchases - fixed_cost_allocation AS net_profit, "
    f"{_FATIGUE} AS fatigue_status, CASE WHEN roas >= b * 1.5 THEN 'Extreme Winner' "
    "WHEN roas >= b * 1.05 THEN 'Genuine Winner' WHEN roas >= b * 0.95 THEN 'Break-Even' "
    "WHEN roas >= 1.5 THEN 'Illusion' ELSE 'Obvious Loser' END AS performance_category, "
    f"{rnd(ratio('purchases', 'impressions'), 6)} AS funnel_dropoff_rate FROM (SELECT * REPLACE ("
    f"{_spelled('platform', _PLATFORMS)} AS platform, {_spelled('product', _PRODUCTS)} AS product, "
    "regexp_replace(campaign_name, '(_v2|_test|_copy)$', '') AS campaign_name), "
    f"cast({_BREAKEVEN} AS decimal(10,4)) AS b FROM ({_FILLED}))"
)

_REPORT = [
    *[f"SELECT 'nulls' AS report, '{c}' AS item, 'nulls' AS figure, cast(count(*) - count({c}) AS double) AS value FROM raw" for c in RAW_LIST],
    "SELECT 'rows', 'raw', 'rows', count(*) FROM raw",
    "SELECT 'rows', 'tagged_duplicates', 'rows', count(*) FROM raw WHERE ends_with(row_id, '_dup')",
    f"SELECT 'rows', 'written', 'rows', count(*) FROM ({_CLEAN})",
    *[
        f"SELECT 'rules', '{name}', '{figure}', count(*) FILTER (WHERE {test}) FROM ({_CLEAN})"
        for name, cond in _RULES.items()
        for figure, test in (("broken_rows", f"NOT ({cond})"), ("unchecked_rows", f"({cond}) IS NULL"))
    ],
    *[
        f"SELECT 'identities', '{name}', '{figure}', cast({figure} AS double) FROM ({_identity(name, formula)})"
        for name, formula in _IDENTITIES.items()
        for figure in ("checked_rows", "mismatches", "one_sided_nulls", "largest_gap")
    ],
]
_LATER = {
    5: "SELECT row_id, 'removed' AS change, cast(NULL AS varchar) AS changed_columns, 1 AS rows_before, 0 AS rows_after",
    6: "SELECT row_id, 'changed', 'spend,clicks', 1, 1",
    7: "SELECT row_id || '-new', 'added', NULL, 0, 1",
    8: "SELECT row_id, 'changed', 'rows', 1, 2",
}
_MISTYPED = (
    "SELECT CASE impressions % 40 WHEN 10 THEN substr(product, 2, 1) || substr(product, 1, 1) || substr(product, 3) "
    "WHEN 20 THEN left(product, 2) || substr(product, 4) WHEN 30 THEN product || 'x' ELSE product END AS product FROM raw"
)

PIPELINE: dict[str, str] = {
    # sources and sinks
    "S1_load_raw": on_raw(_take([*RAW_LIST, "cast(NULL AS varchar) AS _bad"], "raw"), **plain(RAW_LIST)),
    "S2_scan": "SELECT * REPLACE (cast(l_shipdate AS varchar) AS l_shipdate) FROM lineitem",
    "S3_snapshot": on_raw(_FLAT_FROM_RAW, **plain(_FLAT_NAMES)),
    "S4_publish_master": on_facts(
        f"{_STAR} SELECT {', '.join(_PERFORMANCE_MASTER)}, {_DECISION} AS scalability_decision, "
        f"{_COMBINATION} AS creative_combination {_JOINED}",
        **plain(_PERFORMANCE_MASTER),
    ),
    "S3_audited_snapshot": on_raw(f"WITH clean_rows AS ({_CLEAN}) " + _union(_REPORT)),
    "S4_refresh_master": on_facts(
        f"{_STAR} SELECT {', '.join(_PERFORMANCE_MASTER)}, {_DECISION} AS scalability_decision, "
        f"{_COMBINATION} AS creative_combination {_JOINED}",
        **plain(_PERFORMANCE_MASTER),
    ),
    "S5_shared_traps": on_facts(
        f"SELECT *, {rnd('cast(total_spend AS double) / sum(total_spend) OVER () * 100', 4)} AS trap_spend_share_pct "
        f"FROM ({_TRAPS})",
        _TRAP_DOUBLES + " trap_spend_share_pct",
    ),
    "S6_preview": on_facts(
        f"{_STAR} SELECT {', '.join(_PERFORMANCE_MASTER)}, {_DECISION} AS scalability_decision, "
        f"{_COMBINATION} AS creative_combination {_JOINED} ORDER BY row_id LIMIT 10",
        **plain(_PERFORMANCE_MASTER),
    ),
    # cleaning
    "C1_profile_dates": on_raw(
        "SELECT min(date) AS first_date, max(date) AS last_date, count(date) AS dated_rows FROM raw",
        texts="first_date last_date",
    ),
    "C1_profile_ranges": on_raw(
        _union(
            [
                f"SELECT '{c}' AS \"column\", cast(min({c}) AS double) AS min_value, cast(max({c}) AS double) AS "
                f"max_value, count({c}) AS filled_rows FROM raw"
                for c in _NUMBERS
            ]
        )
    ),
    "C1_merged_profile": on_raw(
        _union(
            [
                f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count({c}) AS filled_rows, cast(min({c}) AS double) AS "
                f"min_value, cast(max({c}) AS double) AS max_value FROM raw"
                for c in _NUMBERS
            ]
        )
    ),
    "C1_profile_categories": on_raw(
        _union(
            [
                f"SELECT '{c}' AS \"column\", cast({c} AS varchar) AS \"value\", count(*) AS \"rows\" FROM raw GROUP BY {c}"
                for c in _CATEGORIES
            ]
        )
    ),
    "C2_count_tagged_dups": on_raw(
        "SELECT count(*) AS duplicate_rows FROM raw WHERE row_id LIKE '%\\_dup' ESCAPE '\\'"
    ),
    "C3_drop_tagged_dups": on_raw(
        _take(RAW_LIST, "raw") + " WHERE row_id NOT LIKE '%\\_dup' ESCAPE '\\'", **plain(RAW_LIST)
    ),
    "C4_null_audit": on_raw(
        _union(
            [
                f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, "
                f"{rnd(f'(count(*) - count({c})) / count(*)', 6)} AS null_share FROM raw"
                for c in RAW_LIST
            ]
        ),
        "null_share",
    ),
    "C5_standardise": on_raw(
        f"SELECT row_id, {_spelled('platform', _PLATFORMS)} AS platform, {_spelled('product', _PRODUCTS)} AS product "
        "FROM raw"
    ),
    "C5_unmapped": on_raw(
        'SELECT lower(platform) AS unmapped_value, count(*) AS "rows" FROM raw '
        "WHERE lower(platform) NOT IN ('meta', 'tiktok') GROUP BY lower(platform)"
    ),
    "C5_proposals": on_raw(
        f"WITH typed AS (SELECT lower(trim(product)) AS v, count(*) AS n FROM ({_MISTYPED}) GROUP BY 1), "
        f"known AS (SELECT unnest({_PRODUCTS}) AS c), "
        "near AS (SELECT v, c, CASE WHEN length(v) = length(lower(c)) AND damerau_levenshtein(v, lower(c)) = 1 THEN 1 "
        "ELSE levenshtein(v, lower(c)) END AS d FROM typed, known), "
        "best AS (SELECT v, c, d, count(*) OVER (PARTITION BY v) AS ties FROM (SELECT *, min(d) OVER (PARTITION BY v) AS least "
        "FROM near WHERE d <= 2) WHERE d = least) "
        'SELECT v AS unmapped_value, n AS "rows", c AS proposal, cast(d AS int) AS distance, coalesce(ties, 0) AS ties '
        "FROM typed LEFT JOIN best USING (v) WHERE v NOT IN (SELECT lower(c) FROM known)"
    ),
    "C6_strip_suffix": on_raw(
        "SELECT row_id, CASE WHEN ends_with(campaign_name, '_v2') THEN left(campaign_name, -3) "
        "WHEN ends_with(campaign_name, '_test') OR ends_with(campaign_name, '_copy') THEN left(campaign_name, -5) "
        "ELSE campaign_name END AS campaign_name FROM raw"
    ),
    "C7_impute_mean": on_raw(
        "SELECT row_id, hook_rate, completion_rate, cpa, hook_rate_imputed, completion_rate_imputed "
        f"FROM ({_FILLED})",
        "hook_rate completion_rate cpa",
    ),
    "C8_validate": on_raw(
        "WITH filled AS (" + _FILLED + ") "
        + _union(
            [
                f"SELECT '{name}' AS rule, count(*) FILTER (WHERE NOT ({cond})) AS broken_rows, "
                f"count(*) FILTER (WHERE ({cond}) IS NULL) AS unchecked_rows FROM filled"
                for name, cond in _RULES.items()
            ]
        )
    ),
    "C8_violations": on_raw(_violated()),
    "C9_breakeven_roas": _calculated("breakeven_roas", _BREAKEVEN),
    "C10_contribution_margin": _calculated("contribution_margin", "net_revenue - product_cost * purchases"),
    "C11_net_profit": _calculated("net_profit", "net_revenue - product_cost * purchases - fixed_cost_allocation"),
    "C12_fatigue_status": _calculated("fatigue_status", _FATIGUE),
    "C13_performance_category": _decisions(
        "performance_category",
        "CASE WHEN roas >= breakeven_roas * 1.5 THEN 'Extreme Winner' WHEN roas >= breakeven_roas * 1.05 THEN "
        "'Genuine Winner' WHEN roas >= breakeven_roas * 0.95 THEN 'Break-Even' WHEN roas >= 1.5 THEN 'Illusion' "
        "ELSE 'Obvious Loser' END",
    ),
    "C14_funnel_dropoff_rate": _calculated("funnel_dropoff_rate", rnd(ratio("purchases", "impressions"), 6)),
    "C15_check_identities": on_raw(
        f"WITH clean_rows AS ({_CLEAN}) " + _union([_identity(n, f) for n, f in _IDENTITIES.items()]), "largest_gap"
    ),
    "C_clean_pipeline": on_raw(_FLAT_FROM_RAW, **plain(_FLAT_NAMES)),
    # modelling
    "M1_ad_creative": on_facts(_take(_CREATIVE), **plain(_CREATIVE)),
    "M1_ad_performance": on_facts(_numbered("P", "performance_id", _PERFORMANCE), **plain(_PERFORMANCE)),
    "M1_revenue": on_facts(_numbered("R", "revenue_id", _REVENUE), **plain(_REVENUE)),
    "M2_dim_date": "WITH span AS (SELECT min(cast(o_orderdate AS date)) AS a, max(cast(o_orderdate AS date)) AS z "
    "FROM orders), days AS (SELECT cast(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS date) AS day FROM span) "
    f"SELECT cast(day AS varchar) AS date, {calendar('day')} FROM days",
    "M3_products_dim": on_facts(
        "SELECT DISTINCT product, selling_price, product_cost, gross_margin_pct FROM facts",
        "selling_price product_cost gross_margin_pct",
    ),
    "M4_assign_ids": on_facts(_numbered("P", "performance_id", _PERFORMANCE), **plain(_PERFORMANCE)),
    "M4_revenue_ids": on_facts(_numbered("R", "revenue_id", _REVENUE), **plain(_REVENUE)),
    "M4_continued_ids": on_facts(
        f"SELECT format('P{{:06d}}', row_number() OVER (ORDER BY date >= DATE '1997-01-01', row_id)) AS performance_id, "
        f"{', '.join(_PERFORMANCE)} FROM facts",
        **plain(_PERFORMANCE),
    ),
    "M5_orphan_counts": on_raw(
        "WITH products AS (SELECT DISTINCT product FROM facts WHERE product <> 'Yoga Mat'), "
        "dim_date AS (SELECT DISTINCT date FROM facts WHERE year < 1998) "
        + _union(
            [
                f"SELECT '{child}.{key}' AS foreign_key, count(DISTINCT {key}) AS orphan_keys, count(*) AS orphan_rows "
                f"FROM {rows} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"
                for child, rows, key, parent in (
                    ("ad_creative", "facts", "product", "products"),
                    ("ad_creative", "facts", "date", "dim_date"),
                    ("ad_performance", "raw", "row_id", "facts"),
                    ("revenue", "raw", "row_id", "facts"),
                )
            ]
        )
    ),
    "M5_orphans_of_raw": on_raw(
        'SELECT row_id, count(*) AS "rows" FROM raw WHERE row_id NOT IN (SELECT row_id FROM facts) GROUP BY row_id'
    ),
    "M6_fanout": on_raw(
        "SELECT replace(row_id, '_dup', '') AS row_id, count(*) AS cnt FROM raw GROUP BY 1 HAVING count(*) > 1"
    ),
    "M6_fanout_revenue": on_raw(
        "SELECT replace(row_id, '_dup', '') AS row_id, count(*) AS cnt FROM raw GROUP BY 1 HAVING count(*) > 1"
    ),
    "M6_view_fanout": on_raw(
        "SELECT k AS row_id, count(*) AS cnt FROM facts c JOIN (SELECT replace(row_id, '_dup', '') AS k FROM raw) p "
        "ON c.row_id = p.k JOIN facts r ON r.row_id = c.row_id GROUP BY k HAVING count(*) > 1"
    ),
    "M7_keep_first": on_raw(
        f"WITH enriched AS (SELECT *, {_FATIGUE} AS fatigue_status, "
        f"{rnd(ratio('purchases', 'impressions'), 6)} AS funnel_dropoff_rate FROM raw), "
        f"numbered AS ({_numbered('P', 'performance_id', _PERFORMANCE, 'enriched')}), "
        "kept AS (SELECT * REPLACE (replace(row_id, '_dup', '') AS row_id) FROM numbered) "
        "SELECT * FROM kept WHERE performance_id IN (SELECT min(performance_id) FROM kept GROUP BY row_id)",
        **plain(_PERFORMANCE),
    ),
    "M8_snapshot_diff": on_facts(
        _union([f"{select} FROM facts WHERE impressions % 997 = {turn}" for turn, select in _LATER.items()]),
        bigints="rows_before rows_after",
    ),
    "M8_reconcile": on_raw(
        f"{_STAR} SELECT 'raw' AS source, count(*) AS row_count FROM raw UNION ALL "
        f"SELECT 'raw_without_dups', count(*) FROM ({_CLEAN}) UNION ALL "
        f"SELECT 'backup', count(*) FROM ({_CLEAN}) UNION ALL "
        "SELECT 'ad_creative', count(*) FROM ad_creative UNION ALL "
        "SELECT 'ad_performance', count(*) FROM ad_performance UNION ALL "
        "SELECT 'ad_performance_before_delete', count(*) FROM raw UNION ALL "
        "SELECT 'ad_performance_after_delete', count(DISTINCT replace(row_id, '_dup', '')) FROM raw UNION ALL "
        "SELECT 'revenue', count(*) FROM revenue "
        f"UNION ALL SELECT 'performance_master', count(*) {_JOINED} "
        f"UNION ALL SELECT 'profitability_master', count(*) {_JOINED}"
    ),
    # masters
    "V1_performance_master": on_facts(
        f"{_STAR} SELECT {', '.join(_PERFORMANCE_MASTER)}, {_DECISION} AS scalability_decision, "
        f"{_COMBINATION} AS creative_combination {_JOINED}",
        **plain(_PERFORMANCE_MASTER),
    ),
    "V2_profitability_master": on_facts(
        f"{_STAR} SELECT {', '.join(_PROFIT_MASTER)}, {_LEAK_LIST}, {_GAP} AS roas_vs_breakeven_gap, "
        f"{_PROFIT_STATUS} AS profit_status, {_ADVICE} AS ceo_recommendation {_JOINED}",
        plain(_PROFIT_MASTER)["doubles"] + " " + " ".join(_LEAKS) + " roas_vs_breakeven_gap",
        texts="date",
    ),
    "V3_scalability_decision": _decisions("scalability_decision", _DECISION),
    "V4_creative_combination": _decisions("creative_combination", _COMBINATION),
    "V5_profit_status": _decisions("profit_status", _PROFIT_STATUS),
    "V6_ceo_recommendation": _decisions("ceo_recommendation", _ADVICE),
    "V7_leakage_pcts": on_facts(f"SELECT row_id, {_LEAK_LIST} FROM facts", " ".join(_LEAKS)),
    "V8_roas_vs_breakeven_gap": _decisions("roas_vs_breakeven_gap", _GAP, "roas_vs_breakeven_gap"),
    # scalar functions
    "F1_rnd": on_facts(
        f"SELECT row_id, {rnd('spend / 7', 2)} AS rounded, {rnd('-spend / 8', 2)} AS rounded_negative FROM facts",
        "rounded rounded_negative",
    ),
    "F2_safe_ratio": _decisions("ratio", rnd(ratio("spend", "purchases"), 6), "ratio"),
    "F5_concat": on_facts(
        "SELECT row_id, concat(platform, ':', hook_rate) AS skips_null, platform || ':' || hook_rate AS keeps_null "
        "FROM facts"
    ),
    "F7_like": on_raw("SELECT count(*) AS matches FROM raw WHERE row_id LIKE '%_dup'"),
    "F8_date_parts": on_facts(_take(["row_id", *_CALENDAR_NAMES])),
    "F10_if_error": _decisions("clicks_per_purchase", f"coalesce({rnd(ratio('clicks', 'purchases'), 4)}, 0)", "clicks_per_purchase"),
}
PIPELINE["M7_merge_arrivals"] = PIPELINE["M7_keep_first"]
