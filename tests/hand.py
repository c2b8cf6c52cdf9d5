"""The smallest input folder, and hand-made campaign rows: every column has a default, a test names what matters."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from spendlens.functions.calendar import calendar
from spendlens.schemas import FLAT

SF = "/root/testdata/sf0.001"

DEFAULTS = {
    "date": dt.date(2024, 1, 15),
    "platform": "Meta",
    "campaign_id": "CMP-1",
    "campaign_name": "Meta_P0_2024-01-15",
    "ad_id": "CR-001",
    "product": "Creatine",
    "hook_type": "Story",
    "creative_angle": "Lifestyle",
    "copy_tone": "Casual",
    "ad_format": "Video",
    "has_ugc": 1,
    "selling_price": "40.00",
    "product_cost": "30.00",
    "gross_margin_pct": "0.2500",
    "fixed_cost_allocation": "10.00",
    "impressions": 1000,
    "reach": 500,
    "frequency": "2.00",
    "fatigue_score": "3.0",
    "frequency_at_fatigue": "2.00",
    "creative_score": "7.0",
    "hook_rate": "0.2000",
    "hold_rate_3s": "0.1000",
    "completion_rate": "0.0400",
    "cpm": "10.0000",
    "spend": "10.00",
    "clicks": 40,
    "ctr": "0.0400",
    "cpc": "0.25",
    "purchases": 2,
    "cvr": "0.0500",
    "cpa": "5.00",
    "gross_revenue": "80.00",
    "discount_amount": "4.00",
    "refund_amount": "6.00",
    "net_revenue": "70.00",
    "roas": "7.0000",
    "breakeven_roas": "4.0000",
    "contribution_margin": "10.00",
    "net_profit": "0.00",
    "fatigue_status": "Low Fatigue",
    "performance_category": "Extreme Winner",
    "funnel_dropoff_rate": "0.002000",
}


def flat_rows(spark, *changes: dict):
    """One flat row per dict of changes, with row ids R1, R2, ..."""

    def value(field, row):
        given = row.get(field.name)
        if given is not None and isinstance(field.dataType, T.DecimalType):
            return Decimal(str(given))
        return given

    rows = []
    for i, change in enumerate(changes, start=1):
        row = {"row_id": f"R{i}", **DEFAULTS, **change}
        rows.append(tuple(value(f, row) for f in FLAT))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in FLAT])
    return spark.createDataFrame(rows, schema)


def facts_rows(spark, *changes: dict):
    return flat_rows(spark, *changes).select("*", *calendar("date"))
