"""Campaign table derived from the order tables (``lineitem`` join ``orders``).

One campaign row per line item. All arithmetic is on integers (cents, tenths,
basis points); a single cast turns each figure into its decimal type, so any
engine that follows the same rules gets the same digits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ladders
from ..functions.calendar import CALENDAR_COLUMNS, calendar
from ..labels import AD_FORMATS, COPY_TONES, CREATIVE_ANGLES, DUPLICATE_TAG, HOOK_TYPES, PLATFORMS, PRODUCTS
from ..schemas import CALCULATED_COLUMNS, RAW, RAW_COLUMNS

# The per-platform and per-product parameters.
CLICK_RATES = (180, 350, 120, 150)
CPM_CENTS = (1100, 860, 1590, 1250)
PURCHASE_RATES = (700, 220, 500, 1300)
PRICE_CENTS = (4500, 3500, 4000, 3000, 2500, 4200, 8000, 3800)
COST_BASIS_POINTS = (7500, 7500, 8000, 8000, 7000, 7500, 8500, 7000)


def _nth(values: Sequence, index: str) -> str:
    """SQL for the value at a zero-based index."""
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"element_at(array({items}), cast({index} as int) + 1)"


def _kind(name: str) -> T.DecimalType:
    return CALCULATED_COLUMNS[name] if name in CALCULATED_COLUMNS else RAW_COLUMNS[name][0]


def _fixed(name: str, units: str) -> str:
    """Integer count of the last decimal place -> the decimal column ``name``."""
    kind = _kind(name)
    unit = f"{10 ** -kind.scale:.{kind.scale}f}BD"
    return f"cast(cast({units} as decimal({kind.precision},0)) * {unit} as {kind.simpleString()}) as {name}"


def _split(value: str) -> str:
    """The same value, in a projection that Spark does not put into whole-stage code.

    Some forty columns computed in one method of whole-stage code pass the 8000 bytecodes
    up to which the JVM compiles a method, whatever ``hugeMethodLimit`` the session has; it
    would be interpreted for every row. A lambda function keeps its projection out, and
    Spark splits the code of such a projection into small methods.
    """
    return f"element_at(transform(array({value}), v -> v), 1)"


def _ratio(name: str, top: str, bottom: str) -> str:
    """Rounded quotient of two non-negative integers, in integer arithmetic.

    Rounds half up at ten places and then at the places of ``name``, which is
    what ``rnd`` does with a quotient taken as a double.
    """
    scale = _kind(name).scale
    tens = f"(({top}) * {2 * 10**10} + ({bottom})) div nullif(2 * ({bottom}), 0)"
    return _fixed(name, f"(({tens} + {5 * 10 ** (9 - scale)}) div {10 ** (10 - scale)})")


# The narrow rows from which all figures follow. TAGS stands for the column
# ``tag``, which the messy layer explodes into copies. Both join sides grow with
# the data, so neither is ever broadcast; the narrow rows are shuffled before the
# figures are computed, and adaptive execution splits an order that holds very many lines.
_NARROW = """
with lines as (
  select TAGS, l_orderkey as ok, cast(l_linenumber as bigint) as ln, l_partkey as pk, l_suppkey as sk,
         cast(l_quantity as bigint) as q, cast(round(l_discount * 100) as bigint) as dc,
         cast(round(l_tax * 100) as bigint) as tx
  from {lineitem}
), dated as (
  select o_orderkey, cast(o_orderdate as date) as dt, cast(substr(o_orderpriority, 1, 1) as int) as pr
  from {orders}
)
select /*+ merge(dated) */ COLUMNS from lines join dated on ok = o_orderkey
"""
_NARROW_COLUMNS = ("tag", "ok", "ln", "pk", "sk", "q", "dc", "tx", "dt", "pr")

# Integer figures of each campaign, each step from the one before.
_FIGURES = f"""
with base as (
  select *, pk % 8 as pi, sk % 4 as pf, 2000 + q * 1000 + (pk % 97) * 10 as impressions,
         100 + (ok * 7 + pk) % 500 as fr, 5 + (pk * 3 + ok) % 96 as ft, (pk * 5 + ok) % 53 = 0 as masked,
         if(qt = 4, 12000L, 6000L) as fixed_c
  from (select *, year(dt) as yr, quarter(dt) as qt from {{narrow}})
), rates as (
  select *, {_nth(CPM_CENTS, 'pf')} + tx * 10 as cpm_c, {_nth(CLICK_RATES, 'pf')} + (pk % 7) * 15 as click_rate,
         {_nth(PURCHASE_RATES, 'pf')} + (sk % 5) * 20 - ft * 2 as purchase_rate, 2600 - ft * 15 + (pk % 11) * 30 as hf,
         cast({_nth(PRICE_CENTS, 'pi')} as bigint) as price_c,
         {_nth(tuple(p * c // 10000 for p, c in zip(PRICE_CENTS, COST_BASIS_POINTS)), 'pi')} as cost_c
  from base
), volumes as (
  select *, (impressions * 100) div fr as reach, (impressions * click_rate) div 10000 as clicks,
         (impressions * cpm_c) div 1000 as spend_c
  from rates
), bought as (
  select *, (clicks * purchase_rate) div 10000 as purchases from volumes
), earned as (
  select *, purchases * price_c as gross_c, (purchases * price_c * dc) div 200 as disc_c,
         (purchases * price_c * tx) div 100 as refund_c
  from bought
), kept as (
  select *, gross_c - disc_c - refund_c as net_c from earned
), figures as (
  select *, net_c - cost_c * purchases as margin_c from kept
)
"""

_TYPED = [
    "concat('C', ok, '-', ln, '-', pk, '-', sk, '-', q) as row_id",
    "dt as date",
    f"{_nth(PLATFORMS, 'pf')} as platform",
    "concat('CMP-', ok) as campaign_id",
    f"concat({_nth(PLATFORMS, 'pf')}, '_P', pi, '_', dt) as campaign_name",
    "concat('CR-', lpad(cast(pk % 50 + 1 as string), 3, '0')) as ad_id",
    f"{_nth(PRODUCTS, 'pi')} as product",
    f"{_nth(HOOK_TYPES, 'pr - 1')} as hook_type",
    f"{_nth(CREATIVE_ANGLES, 'ok % 5')} as creative_angle",
    f"{_nth(COPY_TONES, 'pk % 5')} as copy_tone",
    f"{_nth(AD_FORMATS, '(ok + ln) % 5')} as ad_format",
    "cast(ln % 2 as int) as has_ugc",
    _fixed("selling_price", "price_c"),
    _fixed("product_cost", "cost_c"),
    _ratio("gross_margin_pct", "price_c - cost_c", "price_c"),
    _fixed("fixed_cost_allocation", "fixed_c"),
    "impressions",
    "reach",
    _fixed("frequency", "fr"),
    _fixed("fatigue_score", "ft"),
    _fixed("frequency_at_fatigue", "fr"),
    _fixed("creative_score", "105 - ft"),
    _fixed("hook_rate", "if(masked, null, hf)"),
    _fixed("hold_rate_3s", "(hf * 41) div 100"),
    _fixed("completion_rate", "if(masked, null, (hf * 15) div 100)"),
    _fixed("cpm", "cpm_c * 100"),
    _fixed("spend", "spend_c"),
    "clicks",
    _ratio("ctr", "clicks", "impressions"),
    _ratio("cpc", "spend_c", "100 * clicks"),
    "purchases",
    _ratio("cvr", "purchases", "clicks"),
    _ratio("cpa", "spend_c", "100 * purchases"),
    _fixed("gross_revenue", "gross_c"),
    _fixed("discount_amount", "disc_c"),
    _fixed("refund_amount", "refund_c"),
    _fixed("net_revenue", _split("net_c")),  # read by all that reads many columns
    _ratio("roas", "net_c", "spend_c"),
    _ratio("breakeven_roas", "price_c", "price_c - cost_c"),
    _fixed("contribution_margin", "margin_c"),
    _fixed("net_profit", "margin_c - fixed_c"),
    _ratio("funnel_dropoff_rate", "purchases", "impressions"),
]


def _recased(name: str, values: Sequence[str], index: str, lower_at: int, upper_at: int) -> str:
    value = _nth(values, index)
    return (
        f"case when tag = '' and pk % 10 = {lower_at} then lower({value}) "
        f"when tag = '' and pk % 10 = {upper_at} then upper({value}) else {value} end as {name}"
    )


_MESSY = {
    "row_id": "concat('C', ok, '-', ln, '-', pk, '-', sk, '-', q, tag) as row_id",
    "platform": _recased("platform", PLATFORMS, "pf", 0, 1),
    "product": _recased("product", PRODUCTS, "pi", 2, 3),
    "campaign_name": f"concat({_nth(PLATFORMS, 'pf')}, '_P', pi, '_', dt, if(tag = '', case pk % 20 "
    "when 0 then '_v2' when 1 then '_test' when 2 then '_copy' else '' end, '')) as campaign_name",
}
_ONE_COPY = "'' as tag"
_COPIES = f"explode(if((l_orderkey + l_partkey) % 100 = 0, array('', '{DUPLICATE_TAG}'), array(''))) as tag"


def _name(item: str) -> str:
    return item.rsplit(" ", 1)[-1]


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")}


def _narrow_sql(tags: str, *more: str) -> str:
    return _NARROW.replace("TAGS", tags).replace("COLUMNS", ", ".join((*_NARROW_COLUMNS, *more)))


def _joined(spark: SparkSession, sf_dir: str, tags: str = _ONE_COPY, *more: str) -> DataFrame:
    return spark.sql(_narrow_sql(tags, *more), **_tables(spark, sf_dir))


def _figures(narrow: DataFrame, columns: Sequence[str]) -> DataFrame:
    return narrow.sparkSession.sql(f"{_FIGURES}\nselect {', '.join(columns)}\nfrom figures", narrow=narrow)


def _select(spark: SparkSession, sf_dir: str, tags: str, columns: Sequence[str]) -> DataFrame:
    """The figures over the joined rows, in one statement."""
    # A second statement over the first one's result made Spark fail to merge the scalar subqueries of ``impute_mean``.
    lead, join = _narrow_sql(tags).split("\nselect /*+", 1)
    steps = _FIGURES.replace("{narrow}", "joined").replace("with base as (", "base as (", 1)
    text = f"{lead}, joined as (\nselect /*+{join}), {steps}\nselect {', '.join(columns)}\nfrom figures"
    return spark.sql(text, **_tables(spark, sf_dir))


def _labelled(figures: DataFrame) -> DataFrame:
    return figures.select(
        "*",
        *ladders.fatigue_status("fatigue_score").columns("fatigue_status"),
        *ladders.performance_category("roas", "breakeven_roas").columns("performance_category"),
    )


def narrow(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """``row_id`` and the narrow columns from which ``flat_of`` computes the flat table, row by row.

    ``parts`` hashes the rows into so many partitions by ``row_id``, which is a
    text over columns that are shuffled anyway: it is put together on either side.
    """
    if parts is None:
        return _joined(spark, sf_dir, _ONE_COPY, _TYPED[0])
    row_id = _TYPED[0].removesuffix(" as row_id")
    return _joined(spark, sf_dir).repartition(parts, F.expr(row_id)).select("*", F.expr(row_id).alias("row_id"))


def flat_of(narrow: DataFrame) -> DataFrame:
    """The clean flat table of the rows of ``narrow``, which may have been stored and laid out meanwhile."""
    return _labelled(_figures(narrow, ["row_id", *_TYPED[1:]]))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean flat table: 38 raw plus 6 calculated columns."""
    return _labelled(_select(spark, sf_dir, _ONE_COPY, _TYPED))


def facts(spark: SparkSession, sf_dir: str, by_quarter: bool = False) -> DataFrame:
    """Flat table with the calendar attributes of ``date``: the input of every question.

    ``by_quarter`` lays the rows of a quarter together and in order, at the cost
    of a shuffle and a sort of the narrow rows from which the figures are
    computed: a writer by ``year`` and ``quarter`` need not sort the wide rows.
    """
    if not by_quarter:
        return flat(spark, sf_dir).select("*", *calendar("date"))
    laid = _joined(spark, sf_dir, _ONE_COPY, "year(dt) as year", "quarter(dt) as quarter").hint("rebalance", "year", "quarter")
    figures = _labelled(_figures(laid.sortWithinPartitions("year", "quarter"), [*_TYPED, "year", "quarter"]))
    kept = [name for name in figures.columns if name not in ("year", "quarter")]
    return figures.select(*kept, *[name if name in ("year", "quarter") else c for name, c in zip(CALENDAR_COLUMNS, calendar("date"))])


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy 38-column export: odd casing, name suffixes and tagged duplicate rows.

    A duplicate is a second, clean-looking copy of a row under a tagged id; both
    copies come from one pass over the line items.
    """
    typed = {_name(item): item for item in _TYPED}
    return _select(spark, sf_dir, _COPIES, [_MESSY.get(n, typed[n]) for n in RAW.fieldNames()])


def raw_in_order(spark: SparkSession, sf_dir: str, tied: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """The rows of ``raw``, sorted across ``parts`` partitions by ``row_id`` and, those of one id, by the column ``_tie`` that ``tied`` adds.

    The narrow rows are shuffled and sorted. Their figures are computed for
    ``_tie`` before, where that needs them, and for the result afterwards.
    """
    typed = {_name(item): item for item in _TYPED}
    messy = [_MESSY.get(n, typed[n]) for n in RAW.fieldNames()]
    row_id = F.expr(_MESSY["row_id"].removesuffix(" as row_id"))
    rows = tied(_figures(_joined(spark, sf_dir, _COPIES), [*_NARROW_COLUMNS, *messy])).select(*_NARROW_COLUMNS, "_tie")
    # The id is put together on either side of the shuffle, and once a row for the sort.
    laid = rows.repartitionByRange(parts, row_id, "_tie").withColumn("_at", row_id).sortWithinPartitions("_at", "_tie")
    return _figures(laid, messy)


def calendar_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last campaign date, from the orders alone."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.min(F.col("o_orderdate").cast("date")).alias("first_day"),
        F.max(F.col("o_orderdate").cast("date")).alias("last_day"),
    )
