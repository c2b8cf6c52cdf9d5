"""Dashboard KPIs as operators. ``by`` gives the grain; ``slice_by`` filters any input.

``over`` tells how figures are taken: from campaign rows, or from the states of a stored rollup.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions.numeric import ROWS, Figures, exact, mean_to, pct, rnd, sdiv
from ..operators.clean import breakeven_roas
from ..labels import PLATFORMS
from .common import campaigns, with_total

SLICERS = {
    "year": "year",
    "month": "month_number",
    "platform": "platform",
    "product": "product",
    "ad_format": "ad_format",
    "fatigue_status": "fatigue_status",
}


def slice_by(df: DataFrame, **choices) -> DataFrame:
    """Keep the rows that match every given slicer; a list means any of its values.

    Slicers: year, month, platform, product, ad_format, fatigue_status. On a
    published master the year filter selects partitions.
    """
    for slicer, choice in choices.items():
        column = F.col(SLICERS[slicer])
        if choice is None:
            continue
        many = isinstance(choice, (list, tuple, set))
        df = df.filter(column.isin(*choice) if many else column == choice)
    return df


# One aggregate per measure, over rows or their states; trends take their measure from here too.
MEASURES: dict[str, Callable[[Figures], Column]] = {
    "campaigns": lambda x: x.rows(),
    "total_spend": lambda x: x.sum_to("spend"),
    "gross_revenue": lambda x: x.sum_to("gross_revenue"),
    "net_revenue": lambda x: x.sum_to("net_revenue"),
    "total_purchases": lambda x: x.total("purchases"),
    "avg_fatigue_score": lambda x: x.mean_to("fatigue_score", 2),
    "cost_per_unique_reach": lambda x: rnd(sdiv(x.total("spend"), x.total("reach")), 4),
    "hook_rate": lambda x: x.mean_to("hook_rate", 4),
    "hold_rate": lambda x: x.mean_to("hold_rate_3s", 4),
    "completion_rate": lambda x: x.mean_to("completion_rate", 4),
    "ctr": lambda x: rnd(sdiv(x.total("clicks"), x.total("impressions")), 4),
    "cvr": lambda x: rnd(sdiv(x.total("purchases"), x.total("clicks")), 4),
    "mean_roas": lambda x: x.mean_to("roas", 4),
    "net_blended_roas": lambda x: rnd(sdiv(x.total("net_revenue"), x.total("spend")), 4),
    "gross_blended_roas": lambda x: rnd(sdiv(x.total("gross_revenue"), x.total("spend")), 4),
    "breakeven_roas": lambda x: x.mean_to("breakeven_roas", 4),
}


def kpis(df: DataFrame, by: Sequence[str] = (), filters: dict | None = None, over: Figures = ROWS) -> DataFrame:
    """K1. Headline figures; ROAS three ways, since the published one is neither ratio of totals."""
    figures = [build(over).alias(name) for name, build in MEASURES.items()]
    return slice_by(df, **(filters or {})).groupBy(*by).agg(*figures)


def category_share(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """K3. Share of campaigns per value of ``column``, within each group of ``by``."""
    counted = df.groupBy(*by, column).agg(campaigns("campaigns"))
    if by:
        total = F.sum("campaigns").over(Window.partitionBy(*by))
        counted = counted.withColumn("_all", total)
    else:
        counted = with_total(counted, "campaigns", "_all")
    return counted.select(*by, column, "campaigns", pct("campaigns", "_all").alias("share_pct")).orderBy(*by, column)


def awareness(df: DataFrame, over: Figures = ROWS) -> DataFrame:
    """K4. Frequency, cost per reached person and CPM by platform."""
    return (
        df.groupBy("platform")
        .agg(
            over.total("reach").alias("total_reach"),
            over.mean_to("frequency", 2).alias("avg_frequency"),
            rnd(sdiv(over.total("spend"), over.total("reach")), 4).alias("cost_per_unique_reach"),
            over.mean_to("cpm", 2).alias("avg_cpm"),
        )
        .orderBy("platform")
    )


def attention_funnel(df: DataFrame, by: Sequence[str] = (), over: Figures = ROWS) -> DataFrame:
    """K5. Hook to hold to completion, and the share of hooked viewers lost on the way."""
    hook, hold, done = over.mean("hook_rate"), over.mean("hold_rate_3s"), over.mean("completion_rate")
    return df.groupBy(*by).agg(
        rnd(hook, 4).alias("hook_rate"),
        rnd(hold, 4).alias("hold_rate"),
        rnd(done, 4).alias("completion_rate"),
        rnd(sdiv(hold, hook), 4).alias("hook_to_hold"),
        rnd(sdiv(done, hold), 4).alias("hold_to_completion"),
        rnd(1 - sdiv(done, hook), 4).alias("dropoff_share"),
    )


def ugc_effect(df: DataFrame, by: Sequence[str] = ("platform", "ad_format")) -> DataFrame:
    """K6. User-made against other creatives side by side, with the difference.

    Campaigns whose ``has_ugc`` is neither 0 nor 1 are counted in ``campaigns_of_unknown_ugc``.
    """
    figures = {"hook": ("hook_rate", 4), "completion": ("completion_rate", 4), "roas": ("roas", 4)}
    listed = F.when(F.col("has_ugc").isin(0, 1), F.col("has_ugc")).otherwise(-1)
    sides = df.withColumn("_listed", listed).groupBy(*by).pivot("_listed", [0, 1, -1]).agg(
        F.count(F.lit(1)).alias("campaigns"), *[mean_to(c, digits).alias(name) for name, (c, digits) in figures.items()]
    )
    out: list[Column] = [F.col(c) for c in by]
    for side, named in (("0", "without_ugc"), ("1", "with_ugc"), ("-1", "of_unknown_ugc")):
        out.append(F.coalesce(f"{side}_campaigns", F.lit(0)).alias(f"campaigns_{named}"))
    for name in figures:
        out += [F.col(f"0_{name}").alias(f"{name}_without_ugc"), F.col(f"1_{name}").alias(f"{name}_with_ugc")]
        out.append((F.col(f"1_{name}") - F.col(f"0_{name}")).alias(f"{name}_difference"))
    return sides.select(*out)


def acquisition_cost(df: DataFrame, by: Sequence[str] = ("product",), over: Figures = ROWS) -> DataFrame:
    """K7. Spend per purchase, next to the mean of the rows' own cost per acquisition."""
    return df.groupBy(*by).agg(
        over.sum_to("spend").alias("total_spend"),
        over.total("purchases").alias("total_purchases"),
        rnd(sdiv(over.total("spend"), over.total("purchases")), 2).alias("cost_per_acquisition"),
        over.mean_to("cpa", 2).alias("mean_cpa"),
        rnd(sdiv(over.total("clicks"), over.total("impressions")), 4).alias("ctr"),
        rnd(sdiv(over.total("purchases"), over.total("clicks")), 4).alias("cvr"),
    )


def scale_matrix(
    df: DataFrame,
    by: Sequence[str] = ("product", "platform"),
    fatigue_status: str | None = None,
    blended: bool = False,
    flag_nulls: bool = False,
    over: Figures = ROWS,
) -> DataFrame:
    """K8. Scaling decision per cell, optionally for one fatigue status.

    The cell's status is taken from its mean fatigue (assumed); its ROAS is the
    mean of the rows, or net revenue per spend with ``blended``.
    """
    roas = sdiv(over.total("net_revenue"), over.total("spend")) if blended else over.mean("roas")
    cells = (
        slice_by(df, fatigue_status=fatigue_status)
        .groupBy(*by)
        .agg(
            over.rows().alias("campaigns"),
            over.mean("fatigue_score").alias("_fatigue"),
            roas.alias("_roas"),
            over.mean("breakeven_roas").alias("_breakeven"),
        )
        .withColumn("cell_status", ladders.fatigue_status("_fatigue").label)
    )
    return cells.select(
        *by,
        "campaigns",
        rnd("_fatigue", 2).alias("avg_fatigue"),
        "cell_status",
        rnd("_roas", 2).alias("roas"),
        rnd("_breakeven", 2).alias("breakeven"),
        *ladders.scalability("_roas", "_breakeven", "cell_status").columns("scalability_decision", flag_nulls),
    )


def roas_by_fatigue(df: DataFrame, over: Figures = ROWS) -> DataFrame:
    """K9. ROAS against breakeven per fatigue status."""
    return df.groupBy("fatigue_status").agg(
        over.rows().alias("campaigns"),
        over.mean_to("roas", 2).alias("mean_roas"),
        rnd(sdiv(over.total("net_revenue"), over.total("spend")), 2).alias("net_blended_roas"),
        over.mean_to("breakeven_roas", 2).alias("breakeven"),
        rnd(over.mean("roas") - over.mean("breakeven_roas"), 2).alias("roas_vs_breakeven_gap"),
    )


def breakeven_gap_matrix(
    df: DataFrame, platforms: Sequence[str] = PLATFORMS, over: Figures = ROWS
) -> DataFrame:
    """K10. Gap of mean ROAS to mean breakeven: one row per product, one column per platform.

    Campaigns of any other platform, or of none, share the column ``gap_other``.
    """
    gap = rnd(over.mean("roas") - over.mean("breakeven_roas"), 2)
    listed = F.when(F.col("platform").isin(*platforms), F.col("platform")).otherwise("other")
    cells = df.withColumn("_listed", listed).groupBy("product").pivot("_listed", [*platforms, "other"]).agg(gap)
    return cells.select("product", *[F.col(f"`{p}`").alias(f"gap_{p.lower()}") for p in (*platforms, "other")])


def breakeven_table(products: DataFrame) -> DataFrame:
    """K12. Breakeven ROAS of each product, hardest to reach first."""
    return products.select("product", breakeven_roas().alias("breakeven_roas")).orderBy(
        F.desc_nulls_first("breakeven_roas"), "product"
    )


def refresh_due(
    df: DataFrame, by: Sequence[str] = ("ad_id",), cut: float = 4, warn: float = 0.5
) -> DataFrame:
    """T6. Creatives about to leave low fatigue: latest score under ``cut`` by at most ``warn`` (assumed).

    The latest score is the highest of the last day. Reducing to days first
    keeps both steps plain hash aggregates.
    """
    daily = df.groupBy(*by, "date").agg(F.max("fatigue_score").alias("_score"))
    latest = daily.groupBy(*by).agg(
        F.max("date").alias("last_date"), F.max_by("_score", "date").alias("fatigue_score")
    )
    score = F.col("fatigue_score")
    return latest.filter((score < exact(cut)) & (score >= exact(cut) - exact(warn))).withColumn(
        "headroom", exact(cut) - score
    )


def leaving_low_fatigue(df: DataFrame, by: Sequence[str] = ("ad_id",), cut: float = 4) -> DataFrame:
    """T6. The day on which the fitted line of fatigue over time reaches ``cut``, for each creative.

    Columns: ``scored_rows`` (the sample), ``last_date``, ``slope`` (points a
    day, six places), ``crossing_day`` (the first whole day on which the line
    is at the cut or over it) and ``days_left`` from the last scored day, below
    zero if the line crossed before. Slope and crossing are NULL for a single
    day; the crossing is NULL for a flat or falling line as well, and where it
    lies outside the years 1 to 9999.

    The line follows from exact sums over the rows (least squares moments), so
    tasks add up, and no rows of an ad are gathered.
    """
    whole = lambda c: c.cast("decimal(38,4)")
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    scored = df.filter(F.col("fatigue_score").isNotNull() & F.col("date").isNotNull())
    daily = scored.select(*by, "date", day.cast("decimal(10,0)").alias("_x"), F.col("fatigue_score").cast("decimal(8,2)").alias("_y"))
    moments = daily.groupBy(*by).agg(
        F.count("*").alias("scored_rows"),
        F.sum("_x").alias("_sx"),
        F.sum("_y").alias("_sy"),
        F.sum(F.col("_x") * F.col("_x")).alias("_sxx"),
        F.sum(F.col("_x") * F.col("_y")).alias("_sxy"),
        F.min("date").alias("_first"),
        F.max("date").alias("last_date"),
    )
    n = F.col("scored_rows").cast("decimal(12,0)")
    spread = n * whole(F.col("_sxx")) - whole(F.col("_sx")) * F.col("_sx").cast("decimal(20,0)")
    along = n * whole(F.col("_sxy")) - whole(F.col("_sx")) * F.col("_sy").cast("decimal(20,2)")
    slope = sdiv(along, spread)
    reached = (F.col("_sx").cast("double") + sdiv((exact(cut) * n - F.col("_sy")).cast("double"), F.col("_slope"))) / n.cast("double")
    ahead = F.when(F.col("_reached").between(-719_162, 2_932_896), F.ceil(F.round("_reached", 6)).cast("int"))
    return (
        moments.withColumn("_slope", F.when(F.col("_first") < F.col("last_date"), slope))
        .withColumn("_reached", F.when(F.col("_slope") > 0, reached))
        .select(
            *by,
            "scored_rows",
            "last_date",
            rnd("_slope", 6).alias("slope"),
            F.date_add(F.lit("1970-01-01").cast("date"), ahead).alias("crossing_day"),
            (ahead - F.datediff("last_date", F.lit("1970-01-01").cast("date"))).cast("long").alias("days_left"),
        )
    )
