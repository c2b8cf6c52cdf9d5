"""Common table expressions that bind the campaign tables in DuckDB."""

from __future__ import annotations


def rnd(x: str, n: int) -> str:
    """Half-away-from-zero rounding to a decimal."""
    return f"round(cast(cast({x} as double) as decimal(28,10)), {n})"


def ratio(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


def _fixed(x: str, p: int, s: int, unit: str) -> str:
    return f"cast(({x}) * {unit} as decimal({p},{s}))"


def _money(x: str, p: int = 10) -> str:
    return _fixed(x, p, 2, "0.01")


def _rate(a: str, b: str, p: int, s: int) -> str:
    return f"cast({rnd(f'cast({a} as double) / nullif({b}, 0)', s)} as decimal({p},{s}))"


BASE = """
b0 AS (
  SELECT l_orderkey AS ok, cast(l_linenumber AS bigint) AS ln, l_partkey AS pk, l_suppkey AS sk,
         cast(l_quantity AS bigint) AS q, cast(round(l_discount * 100) AS bigint) AS dc,
         cast(round(l_tax * 100) AS bigint) AS tx, cast(o_orderdate AS date) AS dt,
         cast(substr(o_orderpriority, 1, 1) AS int) AS pr, l_partkey % 8 AS pi, l_suppkey % 4 AS pf
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), b1 AS (
  SELECT *, 2000 + q * 1000 + (pk % 97) * 10 AS impressions, 100 + (ok * 7 + pk) % 500 AS fr,
         5 + (pk * 3 + ok) % 96 AS ft, (pk * 5 + ok) % 53 = 0 AS masked,
         [1100, 860, 1590, 1250][pf + 1] + tx * 10 AS cpm_c,
         [4500, 3500, 4000, 3000, 2500, 4200, 8000, 3800][pi + 1] AS price_c,
         6000 + CASE WHEN quarter(dt) = 4 THEN 6000 ELSE 0 END AS fixed_c
  FROM b0
), b2 AS (
  SELECT *, (impressions * 100) // fr AS reach, (impressions * cpm_c) // 1000 AS spend_c,
         (impressions * ([180, 350, 120, 150][pf + 1] + (pk % 7) * 15)) // 10000 AS clicks,
         2600 - ft * 15 + (pk % 11) * 30 AS hf,
         (price_c * [7500, 7500, 8000, 8000, 7000, 7500, 8500, 7000][pi + 1]) // 10000 AS cost_c
  FROM b1
), b3 AS (
  SELECT *, (clicks * ([700, 220, 500, 1300][pf + 1] + (sk % 5) * 20 - ft * 2)) // 10000 AS purchases FROM b2
), b4 AS (
  SELECT *, purchases * price_c AS gross_c, (purchases * price_c * dc) // 200 AS disc_c,
         (purchases * price_c * tx) // 100 AS refund_c FROM b3
), b5 AS (
  SELECT *, gross_c - disc_c - refund_c AS net_c FROM b4
), b6 AS (
  SELECT *, net_c - cost_c * purchases AS margin_c,
         ['Meta', 'TikTok', 'YouTube', 'Google'][pf + 1] AS platform FROM b5
)"""

FLAT = f"""{BASE}, flat0 AS (
  SELECT 'C' || ok || '-' || ln || '-' || pk || '-' || sk || '-' || q AS row_id, dt AS date, platform,
    'CMP-' || ok AS campaign_id, platform || '_P' || pi || '_' || dt AS campaign_name,
    'CR-' || lpad(cast(pk % 50 + 1 AS varchar), 3, '0') AS ad_id,
    ['Whey Protein', 'Creatine', 'Pre-Workout', 'Protein Bars', 'Resistance Bands', 'Foam Roller',
     'Dumbbells', 'Yoga Mat'][pi + 1] AS product,
    ['Question', 'Bold Statement', 'Story', 'Shock', 'Tutorial'][pr] AS hook_type,
    ['Pain Point', 'Transformation', 'Social Proof', 'Educational', 'Lifestyle'][ok % 5 + 1] AS creative_angle,
    ['Motivational', 'Clinical', 'Casual', 'Urgent', 'Empathetic'][pk % 5 + 1] AS copy_tone,
    ['Video', 'Image', 'Carousel', 'Story', 'Reel'][(ok + ln) % 5 + 1] AS ad_format,
    cast(ln % 2 AS int) AS has_ugc,
    {_money('price_c')} AS selling_price, {_money('cost_c')} AS product_cost,
    {_rate('price_c - cost_c', 'price_c', 8, 4)} AS gross_margin_pct,
    {_money('fixed_c')} AS fixed_cost_allocation, impressions, reach,
    {_fixed('fr', 6, 2, '0.01')} AS frequency, {_fixed('ft', 5, 1, '0.1')} AS fatigue_score,
    {_fixed('fr', 6, 2, '0.01')} AS frequency_at_fatigue, {_fixed('105 - ft', 5, 1, '0.1')} AS creative_score,
    CASE WHEN NOT masked THEN {_fixed('hf', 8, 4, '0.0001')} END AS hook_rate,
    {_fixed('(hf * 41) // 100', 8, 4, '0.0001')} AS hold_rate_3s,
    CASE WHEN NOT masked THEN {_fixed('(hf * 15) // 100', 8, 4, '0.0001')} END AS completion_rate,
    {_fixed('cpm_c', 10, 4, '0.01')} AS cpm, {_money('spend_c')} AS spend, clicks,
    {_rate('clicks', 'impressions', 8, 4)} AS ctr, {_rate('spend_c', '100 * clicks', 10, 2)} AS cpc, purchases,
    {_rate('purchases', 'clicks', 8, 4)} AS cvr, {_rate('spend_c', '100 * purchases', 10, 2)} AS cpa,
    {_money('gross_c', 12)} AS gross_revenue, {_money('disc_c', 12)} AS discount_amount,
    {_money('refund_c', 12)} AS refund_amount, {_money('net_c', 12)} AS net_revenue,
    {_rate('net_c', 'spend_c', 10, 4)} AS roas, {_rate('price_c', '(price_c - cost_c)', 10, 4)} AS breakeven_roas,
    {_money('margin_c', 12)} AS contribution_margin, {_money('margin_c - fixed_c', 12)} AS net_profit,
    CASE WHEN ft < 40 THEN 'Low Fatigue' WHEN ft < 70 THEN 'Medium Fatigue' ELSE 'High Fatigue' END AS fatigue_status,
    {_rate('purchases', 'impressions', 10, 6)} AS funnel_dropoff_rate, pk, ok
  FROM b6
), flat1 AS (
  SELECT *, CASE WHEN roas >= breakeven_roas * 1.5 THEN 'Extreme Winner'
                 WHEN roas >= breakeven_roas * 1.05 THEN 'Genuine Winner'
                 WHEN roas >= breakeven_roas * 0.95 THEN 'Break-Even'
                 WHEN roas >= 1.5 THEN 'Illusion' ELSE 'Obvious Loser' END AS performance_category
  FROM flat0
)"""

_CALENDAR = """dayname(d) AS day_of_week, cast(weekofyear(d) AS int) AS week_number,
    cast(month(d) AS int) AS month_number, monthname(d) AS month_name, cast(quarter(d) AS int) AS quarter,
    'Q' || quarter(d) AS quarter_label, cast(year(d) AS int) AS year,
    year(d) || '-Q' || quarter(d) AS year_quarter, strftime(d, '%Y-%m') AS year_month,
    dayofweek(d) IN (0, 6) AS is_weekend"""


def calendar(day: str) -> str:
    return _CALENDAR.replace("(d", f"({day}")


FACTS = f"""{FLAT}, facts AS (SELECT * EXCLUDE (pk, ok), {calendar('date')} FROM flat1)"""

_RAW_NAMES = (
    "row_id, date, platform, campaign_id, campaign_name, ad_id, product, hook_type, creative_angle, copy_tone, "
    "ad_format, has_ugc, selling_price, product_cost, gross_margin_pct, fixed_cost_allocation, impressions, reach, "
    "frequency, fatigue_score, frequency_at_fatigue, creative_score, hook_rate, hold_rate_3s, completion_rate, cpm, "
    "spend, clicks, ctr, cpc, purchases, cvr, cpa, gross_revenue, discount_amount, refund_amount, net_revenue, roas"
)
RAW_LIST = _RAW_NAMES.split(", ")
CALCULATED_LIST = [
    "breakeven_roas",
    "contribution_margin",
    "net_profit",
    "fatigue_status",
    "performance_category",
    "funnel_dropoff_rate",
]

RAW = f"""{FACTS}, raw AS (
  SELECT {_RAW_NAMES} FROM (
    SELECT * REPLACE (
      CASE pk % 10 WHEN 0 THEN lower(platform) WHEN 1 THEN upper(platform) ELSE platform END AS platform,
      CASE pk % 10 WHEN 2 THEN lower(product) WHEN 3 THEN upper(product) ELSE product END AS product,
      campaign_name || CASE pk % 20 WHEN 0 THEN '_v2' WHEN 1 THEN '_test' WHEN 2 THEN '_copy' ELSE '' END
        AS campaign_name)
    FROM flat1)
  UNION ALL
  SELECT {_RAW_NAMES.replace('row_id', "row_id || '_dup' AS row_id", 1)} FROM flat1 WHERE (ok + pk) % 100 = 0
)"""

DECIMALS = {
    "selling_price", "product_cost", "gross_margin_pct", "fixed_cost_allocation", "frequency", "fatigue_score",
    "frequency_at_fatigue", "creative_score", "hook_rate", "hold_rate_3s", "completion_rate", "cpm", "spend", "ctr",
    "cpc", "cvr", "cpa", "gross_revenue", "discount_amount", "refund_amount", "net_revenue", "roas",
    "breakeven_roas", "contribution_margin", "net_profit", "funnel_dropoff_rate",
}


def _query(prelude: str, body: str, doubles: str, bigints: str, texts: str) -> str:
    kinds = {"double": doubles, "bigint": bigints, "varchar": texts}
    casts = [f'cast("{c}" AS {kind}) AS "{c}"' for kind, names in kinds.items() for c in names.split()]
    star = f"* REPLACE ({', '.join(casts)})" if casts else "*"
    return f"WITH {prelude}\nSELECT {star} FROM (\n{body}\n)"


def on_facts(body: str, doubles: str = "", bigints: str = "", texts: str = "") -> str:
    """Query over ``facts``; names the columns to hand over as double, bigint or text."""
    return _query(FACTS, body, doubles, bigints, texts)


def on_raw(body: str, doubles: str = "", bigints: str = "", texts: str = "") -> str:
    return _query(RAW, body, doubles, bigints, texts)


def plain(names: list[str]) -> dict[str, str]:
    """Casts for columns taken over unchanged."""
    return {
        "doubles": " ".join(n for n in names if n in DECIMALS),
        "texts": "date" if "date" in names else "",
    }
