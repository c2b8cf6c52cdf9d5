"""Column types of the raw export, the flat campaign table and the star schema."""

from __future__ import annotations

from pyspark.sql import types as T


def _dec(precision: int, scale: int) -> T.DecimalType:
    return T.DecimalType(precision, scale)


# name -> (type, nullable). row_id stays text because duplicate rows carry a tag.
RAW_COLUMNS: dict[str, tuple[T.DataType, bool]] = {
    # identity and creative
    "row_id": (T.StringType(), False),
    "date": (T.DateType(), False),
    "platform": (T.StringType(), False),
    "campaign_id": (T.StringType(), False),
    "campaign_name": (T.StringType(), False),
    "ad_id": (T.StringType(), False),
    "product": (T.StringType(), False),
    "hook_type": (T.StringType(), False),
    "creative_angle": (T.StringType(), False),
    "copy_tone": (T.StringType(), False),
    "ad_format": (T.StringType(), False),
    "has_ugc": (T.IntegerType(), False),
    # product economics
    "selling_price": (_dec(10, 2), False),
    "product_cost": (_dec(10, 2), False),
    "gross_margin_pct": (_dec(8, 4), False),
    "fixed_cost_allocation": (_dec(10, 2), False),
    # funnel base and fatigue
    "impressions": (T.LongType(), False),
    "reach": (T.LongType(), False),
    "frequency": (_dec(6, 2), False),
    "fatigue_score": (_dec(5, 1), False),
    "frequency_at_fatigue": (_dec(6, 2), True),
    "creative_score": (_dec(5, 1), False),
    "hook_rate": (_dec(8, 4), True),
    # engagement and spend
    "hold_rate_3s": (_dec(8, 4), False),
    "completion_rate": (_dec(8, 4), True),
    "cpm": (_dec(10, 4), False),
    "spend": (_dec(10, 2), False),
    "clicks": (T.LongType(), False),
    "ctr": (_dec(8, 4), True),
    "cpc": (_dec(10, 2), True),
    "purchases": (T.LongType(), False),
    # conversion and revenue
    "cvr": (_dec(8, 4), True),
    "cpa": (_dec(10, 2), True),
    "gross_revenue": (_dec(12, 2), False),
    "discount_amount": (_dec(12, 2), False),
    "refund_amount": (_dec(12, 2), False),
    "net_revenue": (_dec(12, 2), False),
    "roas": (_dec(10, 4), True),
}

CALCULATED_COLUMNS: dict[str, T.DataType] = {
    "breakeven_roas": _dec(10, 4),
    "contribution_margin": _dec(12, 2),
    "net_profit": _dec(12, 2),
    "fatigue_status": T.StringType(),
    "performance_category": T.StringType(),
    "funnel_dropoff_rate": _dec(10, 6),
}

RAW = T.StructType([T.StructField(n, t, nullable) for n, (t, nullable) in RAW_COLUMNS.items()])
FLAT = T.StructType(list(RAW) + [T.StructField(n, t, True) for n, t in CALCULATED_COLUMNS.items()])

CATEGORY_COLUMNS = (
    "platform",
    "product",
    "hook_type",
    "creative_angle",
    "copy_tone",
    "ad_format",
    "has_ugc",
)
NUMERIC_COLUMNS = tuple(
    n for n, (t, _) in RAW_COLUMNS.items() if isinstance(t, (T.DecimalType, T.LongType))
)

# Star schema: columns of each table, without the generated child keys.
CREATIVE_COLUMNS = (
    "row_id",
    "campaign_id",
    "campaign_name",
    "ad_id",
    "date",
    "platform",
    "product",
    "hook_type",
    "creative_angle",
    "copy_tone",
    "ad_format",
    "has_ugc",
)
PERFORMANCE_COLUMNS = (
    "row_id",
    "impressions",
    "reach",
    "frequency",
    "fatigue_score",
    "fatigue_status",
    "creative_score",
    "hook_rate",
    "hold_rate_3s",
    "completion_rate",
    "funnel_dropoff_rate",
    "spend",
    "cpm",
    "clicks",
    "ctr",
    "cpc",
    "purchases",
    "cvr",
    "cpa",
)
REVENUE_COLUMNS = (
    "row_id",
    "gross_revenue",
    "discount_amount",
    "refund_amount",
    "net_revenue",
    "roas",
    "breakeven_roas",
    "contribution_margin",
    "fixed_cost_allocation",
    "net_profit",
    "performance_category",
)
PRODUCT_COLUMNS = ("product", "selling_price", "product_cost", "gross_margin_pct")
