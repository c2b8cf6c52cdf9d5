"""Rounding, ratios, ladders and text on hand-made rows."""

from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlens.functions import ladders
from spendlens.functions.numeric import exact, mean, mean_to, money_ratio, pct, rnd, sdiv
from spendlens.labels import PERFORMANCE_CATEGORIES
from spendlens.functions.text import canonical, is_tagged, spellings, without_suffix


def values(df, column):
    return [r[column] for r in df.collect()]


def test_rnd_goes_half_away_from_zero(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.005,), (0.125,), (None,)], "x double")
    assert values(df.select(rnd("x", 2).alias("r")), "r") == [
        D("1.01"), D("2.68"), D("-1.01"), D("0.13"), None,
    ]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-(10**8), 10**8), min_size=1, max_size=20))
def test_rnd_equals_decimal_quantize(spark, cents):
    from decimal import ROUND_HALF_UP

    rows = [(D(c) / 10**5,) for c in cents]
    df = spark.createDataFrame(rows, "x decimal(18,5)")
    want = [x.quantize(D("0.01"), ROUND_HALF_UP) for (x,) in rows]
    assert values(df.select(rnd("x", 2).alias("r")), "r") == want


def test_ratio_of_zero_and_null(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (None, 2), (3, None)], "a long, b long")
    assert values(df.select(sdiv("a", "b").alias("r")), "r") == [0.25, None, None, None]
    assert values(df.select(pct("a", "b").alias("r")), "r") == [D("25.00"), None, None, None]


def test_mean_is_exact_at_a_threshold(spark):
    """0.54 / 3 as a double is above 0.18."""
    df = spark.createDataFrame([(D("0.17"),), (D("0.18"),), (D("0.19"),), (None,)], "x decimal(8,4)")
    row = df.agg(mean("x").alias("m"), (mean("x") > exact(0.18)).alias("above"), mean_to("x", 2).alias("r")).first()
    assert row.m == D("0.18") and row.above is False and row.r == D("0.18")
    assert df.filter("x > 1").agg(mean("x").alias("m")).first().m is None


def test_money_ratio(spark):
    df = spark.createDataFrame([(D("0.54"), D("3.60")), (D("1.00"), D("0.00"))], "a decimal(12,2), b decimal(12,2)")
    assert values(df.select((money_ratio("a", "b") < exact(0.15)).alias("r")), "r") == [False, None]


@pytest.mark.parametrize(
    "roas, breakeven, status, want, rank",
    [
        ("5", "4", "Low Fatigue", "Scale", 1),
        ("4", "4", "Low Fatigue", "Scale", 1),
        ("5", "4", "Medium Fatigue", "Monitor", 2),
        ("3", "4", "Low Fatigue", "Optimise", 3),
        ("5", "4", "High Fatigue", "Kill", 4),
        ("3", "4", "Medium Fatigue", "Kill", 4),
        (None, "4", "Low Fatigue", "Kill", 4),
        ("5", "4", None, "Kill", 4),
    ],
)
def test_scalability_branches(spark, roas, breakeven, status, want, rank):
    df = spark.createDataFrame(
        [(roas and D(roas), D(breakeven), status)], "r decimal(10,4), b decimal(10,4), s string"
    )
    ladder = ladders.scalability("r", "b", "s")
    row = df.select(*ladder.columns("label", flag_nulls=True), ladder.rank.alias("rank")).first()
    assert (row.label, row.rank) == (want, rank)
    assert row.label_is_null_input == (roas is None or status is None)


@pytest.mark.parametrize(
    "profit, roas, fatigue, want",
    [
        ("1", "4.8", "4.9", "Double Down"),
        ("1", "4.7", "4.9", "Deprioritise"),  # profitable and fresh, but ROAS too weak: no branch fits
        ("1", "4.8", "5.0", "Maintain"),
        ("1", "1.0", "9.0", "Maintain"),
        ("0", "3.6", "1.0", "Optimise"),
        ("-1", "3.5", "1.0", "Deprioritise"),
        (None, "9.0", "1.0", "Deprioritise"),
    ],
)
def test_recommendation_branches(spark, profit, roas, fatigue, want):
    df = spark.createDataFrame(
        [(profit and D(profit), D(roas), D("4"), D(fatigue))],
        "p decimal(12,2), r decimal(10,4), b decimal(10,4), f decimal(5,1)",
    )
    assert df.select(ladders.recommendation("p", "r", "b", "f").label.alias("l")).first().l == want


def test_category_status_band_and_profit_edges(spark):
    df = spark.createDataFrame(
        [("6.0", "4.0"), ("4.2", "4.0"), ("3.8", "4.0"), ("1.5", "4.0"), ("1.4", "4.0"), (None, "4.0")],
        "r string, b string",
    ).select(F.col("r").cast("decimal(10,4)"), F.col("b").cast("decimal(10,4)"))
    got = values(df.select(ladders.performance_category("r", "b").label.alias("l")), "l")
    assert got == [*PERFORMANCE_CATEGORIES, "Obvious Loser"]

    scores = spark.createDataFrame([(D(s),) for s in ("0.5", "1.9", "2.0", "3.9", "4.0", "6.9", "7.0", "8.0")], "s decimal(5,1)")
    status = values(scores.select(ladders.fatigue_status("s").label.alias("l")), "l")
    assert status == ["Low Fatigue"] * 4 + ["Medium Fatigue"] * 2 + ["High Fatigue"] * 2
    bands = values(scores.select(ladders.fatigue_band("s").label.alias("l")), "l")
    assert [b[0] for b in bands] == list("11223445")

    profits = spark.createDataFrame([(D("0.01"),), (D(0),), (D("-0.01"),), (None,)], "p decimal(12,2)")
    assert values(profits.select(ladders.profit_status("p").label.alias("l")), "l") == [
        "Profitable", "Break-Even", "Loss", "Loss",
    ]


def test_tags_suffixes_and_spelling(spark):
    ids = spark.createDataFrame([("Adup",), ("R1_dup",), ("R2",)], "i string")
    assert values(ids.select(is_tagged("i").alias("t")), "t") == [False, True, False]
    assert values(ids.select(is_tagged("i", exact_like=True).alias("t")), "t") == [True, True, False]

    names = spark.createDataFrame([("a_v2",), ("a_test_copy",), ("a_v2_b",), ("a",)], "n string")
    assert values(names.select(without_suffix("n").alias("s")), "s") == ["a", "a_test", "a_v2_b", "a"]
    assert values(names.select(without_suffix("n", stacked=True).alias("s")), "s") == ["a", "a", "a_v2_b", "a"]

    words = spark.createDataFrame([(" TIKTOK ",), ("Pre-workout",), ("snap",), (None,)], "w string")
    mapping = spellings(("TikTok", "Pre-Workout"))
    assert values(words.select(canonical("w", mapping).alias("c")), "c") == ["TikTok", "Pre-Workout", None, None]
