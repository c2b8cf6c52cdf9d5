"""Cleaning and enrichment of the raw export."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions.numeric import as_column, mean, rnd, sdiv
from ..functions.text import canonical, is_tagged, spelling_key, spellings, without_suffix
from ..labels import PLATFORMS, PRODUCTS
from ..schemas import (
    CALCULATED_COLUMNS,
    CATEGORY_COLUMNS,
    NUMERIC_COLUMNS,
    RAW_COLUMNS,
)


# --- looking at the data -------------------------------------------------


def profile_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """First and last date and the number of rows that have one."""
    return df.agg(
        F.min(column).alias("first_date"), F.max(column).alias("last_date"), F.count(column).alias("dated_rows")
    )


def profile_ranges(
    df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS, approx_distinct: bool = False
) -> DataFrame:
    """Minimum, maximum and filled rows of each numeric column, in one pass.

    ``approx_distinct`` adds a sketch-based distinct count per column.
    """

    def figures(name: str) -> Column:
        value = F.col(name).cast("double")
        parts = [
            F.lit(name).alias("column"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            F.count(name).alias("filled_rows"),
        ]
        if approx_distinct:
            parts.append(F.approx_count_distinct(name).alias("approx_distinct"))
        return F.struct(*parts)

    return df.agg(F.array(*[figures(c) for c in columns]).alias("f")).select(F.inline("f"))


def profile_categories(df: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS) -> DataFrame:
    """Rows per value of each categorical column, in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("rows"))


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs and their share for every column, in one pass."""
    names = list(columns or df.columns)
    flags = [F.col(c).isNull().cast("int") for c in names]
    counted = _state_counts(df, names, flags)
    whole = F.sum("_n").over(Window.partitionBy("column"))
    return (
        counted.withColumn("_rows", whole)
        .groupBy("column")
        .agg(F.coalesce(F.sum(F.when(F.col("_state") == 1, F.col("_n"))), F.lit(0)).alias("nulls"), F.max("_rows").alias("_rows"))
        .select("column", "nulls", rnd(sdiv("nulls", "_rows"), 6).alias("null_share"))
    )


def _state_counts(df: DataFrame, names: Sequence[str], states: Sequence[Column]) -> DataFrame:
    """(column, _state, _n): how many rows are in each state (0, 1 or 2) of each named expression.

    Each row is reduced to a few longs of two bits an expression, and rows are
    counted by these, so that the wide row is left behind by the first
    aggregate. At least one row per name comes back, for an empty ``df`` with no rows in it.
    """
    at_once = 31
    masks = {}
    for start in range(0, len(states), at_once):
        bits = [F.shiftleft(s.cast("long"), 2 * i) for i, s in enumerate(states[start : start + at_once])]
        masks[f"_mask{start // at_once}"] = reduce(Column.bitwiseOR, bits)
    counted = df.select(*[m.alias(n) for n, m in masks.items()]).groupBy(*masks).agg(F.count("*").alias("_n"))
    none = df.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(m) for m in masks], F.lit(0).cast("long").alias("_n"))
    parts = [
        F.struct(
            F.lit(name).alias("column"),
            F.shiftrightunsigned(f"_mask{i // at_once}", 2 * (i % at_once)).bitwiseAND(F.lit(3)).alias("_state"),
            F.col("_n"),
        )
        for i, name in enumerate(names)
    ]
    return counted.unionByName(none).select(F.inline(F.array(*parts))).groupBy("column", "_state").agg(F.sum("_n").alias("_n"))


def unexpected_nulls(
    df: DataFrame, expected: Iterable[str] = ("hook_rate", "completion_rate", "cpa")
) -> DataFrame:
    """Columns that hold NULLs although they are not listed as allowed to."""
    return null_audit(df).filter((F.col("nulls") > 0) & ~F.col("column").isin(*expected))


# --- duplicates ----------------------------------------------------------


def count_tagged_dups(df: DataFrame, exact_like: bool = False) -> DataFrame:
    return df.agg(F.count_if(is_tagged("row_id", exact_like=exact_like)).alias("duplicate_rows"))


def drop_tagged_dups(df: DataFrame, exact_like: bool = False) -> DataFrame:
    """Rows without the tag; a NULL id has none, so its row stays."""
    return df.filter(~F.coalesce(is_tagged("row_id", exact_like=exact_like), F.lit(False)))


# --- spelling ------------------------------------------------------------


def standardise(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Canonical spelling of ``column``; a value the mapping lacks stays as it is."""
    return df.withColumn(column, F.coalesce(canonical(column, mapping), F.col(column)))


def unmapped(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Values that ``standardise`` leaves alone, with their row counts."""
    return (
        df.filter(F.col(column).isNotNull() & canonical(column, mapping).isNull())
        .groupBy(spelling_key(column).alias("unmapped_value"))
        .agg(F.count("*").alias("rows"))
    )


def strip_suffix(df: DataFrame, column: str = "campaign_name", stacked: bool = False) -> DataFrame:
    return df.withColumn(column, without_suffix(column, stacked=stacked))


def spelling_proposals(df: DataFrame, column: str, mapping: Mapping[str, str], max_distance: int = 2) -> DataFrame:
    """For each value that ``standardise`` leaves alone, the canonical spellings nearest to it.

    Columns: ``unmapped_value``, ``rows``, ``proposal``, ``distance`` and ``ties``,
    the number of canonical values at that distance, each in a row of its own.
    A value with none within ``max_distance`` edits has one row without proposal.
    Edits are letters put in, left out or replaced; two neighbours swapped, and
    nothing else, are one edit. Case and outer white space don't count.

    The table is only reduced to its distinct values. These meet canonical ones
    of about their length that share one of the first two letters; a value with
    both first letters wrong finds nothing.
    """
    values = unmapped(df, column, mapping).withColumn("_v", F.col("unmapped_value"))
    known = df.sparkSession.createDataFrame([(c, c.lower()) for c in sorted(set(mapping.values()))], "proposal string, _c string")

    def first_letters(name: str) -> Column:
        return F.explode(F.array_distinct(F.array(F.substring(name, 1, 1), F.substring(name, 2, 1)))).alias("_letter")

    lengths = F.explode(F.sequence(F.length("_v") - max_distance, F.length("_v") + max_distance)).alias("_length")
    blocks = values.select("_v", lengths).select("_v", "_length", first_letters("_v"))
    met = blocks.join(known.select("proposal", "_c", F.length("_c").alias("_length"), first_letters("_c")), ["_length", "_letter"])
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length("_v") - 1, F.lit(1))),
        lambda i: F.concat(
            F.substring("_v", F.lit(1), i - 1), F.substring("_v", i + 1, F.lit(1)), F.substring("_v", i, F.lit(1)),
            F.substring("_v", i + 2, F.length("_v")),
        ) == F.col("_c"),
    )
    distance = F.when(swapped, 1).otherwise(F.levenshtein("_v", "_c"))
    near = met.select("_v", "proposal", distance.alias("distance")).distinct().filter(F.col("distance") <= max_distance)
    order = Window.partitionBy("_v")
    best = near.withColumn("_least", F.min("distance").over(order)).filter(F.col("distance") == F.col("_least"))
    best = best.withColumn("ties", F.count("*").over(order)).drop("_least")
    return values.join(best, "_v", "left").select(
        "unmapped_value", "rows", "proposal", "distance", F.coalesce("ties", F.lit(0).cast("long")).alias("ties")
    )


# --- missing values ------------------------------------------------------


def impute_mean(
    df: DataFrame, columns: Sequence[str] = ("hook_rate", "completion_rate"), skip: Sequence[str] = ("cpa",)
) -> DataFrame:
    """Fill NULLs with the column mean over all rows and flag the filled ones.

    The mean is rounded to the scale of the column. Columns in ``skip`` are
    never filled: a row without purchases has no cost per acquisition.
    """
    wanted = [c for c in columns if c not in skip]
    if not wanted:
        return df
    means = df.agg(F.struct(*[mean(c).alias(c) for c in wanted])).scalar()
    types = {f.name: f.dataType for f in df.schema}
    with_means = df.withColumn("_means", means)
    filled = {}
    for name in wanted:
        kind = types[name]
        value = F.col("_means")[name]
        scale = getattr(kind, "scale", None)
        value = value.cast(kind) if scale is None else rnd(value, scale).cast(kind)
        filled[name] = F.coalesce(F.col(name), value)
        filled[f"{name}_imputed"] = F.col(name).isNull()
    return with_means.withColumns(filled).drop("_means")


# --- rules ---------------------------------------------------------------


def default_rules(max_roas: float = 10) -> dict[str, Column]:
    """Range rules of the export; a NULL value breaks none of them."""
    c = F.col
    rules = {
        f"{name}_in_0_1": c(name).between(0, 1)
        for name in ("hook_rate", "hold_rate_3s", "completion_rate", "ctr", "cvr")
    }
    rules |= {
        f"{name}_not_negative": c(name) >= 0
        for name in ("spend", "gross_revenue", "discount_amount", "refund_amount", "net_revenue")
    }
    rules |= {
        "roas_below_max": c("roas") < max_roas,
        "frequency_at_least_1": c("frequency") >= 1,
        "hook_rate_max": c("hook_rate") <= 0.40,
        "hold_below_hook": c("hold_rate_3s") < c("hook_rate"),
        "completion_below_hold": c("completion_rate") < c("hold_rate_3s"),
    }
    return rules


def validate(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Broken and unchecked (NULL) rows per rule, in one pass."""
    rules = dict(rules or default_rules())
    # 0: holds, 1: broken, 2: not to be told.
    states = [F.coalesce((~holds).cast("int"), F.lit(2)) for holds in rules.values()]
    counted = _state_counts(df, list(rules), states)

    def rows_in(state: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_state") == state, F.col("_n"))), F.lit(0))

    return counted.groupBy(F.col("column").alias("rule")).agg(
        rows_in(1).alias("broken_rows"), rows_in(2).alias("unchecked_rows")
    )


def violations(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break."""
    rules = dict(rules or default_rules())
    names = F.array_compact(F.array(*[F.when(~holds, F.lit(name)) for name, holds in rules.items()]))
    # A filter is not pushed below what is observed: every rule would be spelled out down to the
    # source columns, computed there once more, and in as few tasks as the source has splits.
    named = df.withColumn("broken_rules", names).observe(f"rules-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
    return named.filter(F.size("broken_rules") > 0)


# --- calculated columns --------------------------------------------------


def breakeven_roas(price: Column | str = "selling_price", cost: Column | str = "product_cost") -> Column:
    """Return on ad spend at which the goods are just paid for."""
    return rnd(sdiv(price, as_column(price) - as_column(cost)), 4).cast(CALCULATED_COLUMNS["breakeven_roas"])


def contribution_margin() -> Column:
    margin = F.col("net_revenue") - F.col("product_cost") * F.col("purchases")
    return margin.cast(CALCULATED_COLUMNS["contribution_margin"])


def net_profit() -> Column:
    """Contribution margin less fixed cost. Ad spend is *not* deducted."""
    profit = F.col("contribution_margin") - F.col("fixed_cost_allocation")
    return profit.cast(CALCULATED_COLUMNS["net_profit"])


def funnel_dropoff_rate() -> Column:
    """Purchases per impression: a conversion rate, whatever the name says."""
    return rnd(sdiv("purchases", "impressions"), 6).cast(CALCULATED_COLUMNS["funnel_dropoff_rate"])


def enrich(
    df: DataFrame,
    fatigue_cuts: Sequence[float] = (4, 7),
    category_cuts: Sequence[float] = (1.5, 1.05, 0.95),
    category_floor: float = 1.5,
    flag_nulls: bool = False,
) -> DataFrame:
    """Add the six calculated columns."""
    priced = df.withColumns(
        {
            "breakeven_roas": breakeven_roas(),
            "contribution_margin": contribution_margin(),
            "funnel_dropoff_rate": funnel_dropoff_rate(),
        }
    ).withColumn("net_profit", net_profit())
    status = ladders.fatigue_status("fatigue_score", fatigue_cuts)
    category = ladders.performance_category("roas", "breakeven_roas", category_cuts, category_floor)
    return priced.select(
        "*", *status.columns("fatigue_status", flag_nulls), *category.columns("performance_category", flag_nulls)
    )


def identities() -> dict[str, tuple[str, Column]]:
    """Stored metric -> (column, its formula from the base columns)."""
    c = F.col
    return {
        "frequency": ("frequency", sdiv("impressions", "reach")),
        "gross_margin_pct": ("gross_margin_pct", sdiv(c("selling_price") - c("product_cost"), "selling_price")),
        "cpm": ("cpm", sdiv(c("spend") * 1000, "impressions")),
        "ctr": ("ctr", sdiv("clicks", "impressions")),
        "cpc": ("cpc", sdiv("spend", "clicks")),
        "cvr": ("cvr", sdiv("purchases", "clicks")),
        "cpa": ("cpa", sdiv("spend", "purchases")),
        "gross_revenue": ("gross_revenue", (c("purchases") * c("selling_price")).cast("double")),
        "net_revenue": (
            "net_revenue",
            (c("gross_revenue") - c("discount_amount") - c("refund_amount")).cast("double"),
        ),
        "roas": ("roas", sdiv("net_revenue", "spend")),
    }


def check_identities(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """How often a stored metric differs from its formula by more than ``tolerance``.

    One-sided NULLs are counted apart; the largest gap is given to six places.
    """
    results = []
    for name, (stored, formula) in identities().items():
        gap = F.abs(F.col(stored).cast("double") - formula)
        results.append(
            F.struct(
                F.lit(name).alias("identity"),
                F.count(gap).alias("checked_rows"),
                F.count_if(rnd(gap, 8) > tolerance).alias("mismatches"),
                F.count_if(F.col(stored).isNull() != formula.isNull()).alias("one_sided_nulls"),
                rnd(F.max(gap), 6).alias("largest_gap"),
            )
        )
    return df.agg(F.array(*results).alias("r")).select(F.inline("r"))


# --- the whole sequence --------------------------------------------------


def clean(raw: DataFrame) -> DataFrame:
    """Raw export to clean flat table: duplicates out, spelling fixed, gaps filled, columns added.

    Run ``validate`` and ``unexpected_nulls`` on the result; they only report.
    """
    unique = drop_tagged_dups(raw)
    spelled = standardise(standardise(unique, "platform", spellings(PLATFORMS)), "product", spellings(PRODUCTS))
    filled = impute_mean(strip_suffix(spelled))
    return enrich(filled.select(*RAW_COLUMNS))
