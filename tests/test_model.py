import datetime as dt

import pytest
from pyspark.sql import functions as F

from hand import flat_rows
from spendlens.operators import master, model


@pytest.fixture()
def star(spark):
    flat = flat_rows(spark, {}, {"product": "Yoga Mat", "date": dt.date(2024, 3, 2)}, {"platform": "Google"})
    return model.normalise(flat)


def test_normalise_numbers_children_in_row_id_order(star):
    rows = star.performance.orderBy("performance_id").select("performance_id", "row_id").collect()
    assert rows == [("P000001", "R1"), ("P000002", "R2"), ("P000003", "R3")]
    assert star.revenue.columns[0] == "revenue_id"
    assert star.dates.count() == 48 and star.products.count() == 2


def test_ids_are_consecutive_even_when_one_value_fills_most_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    ids = model.assign_ids(df, "n", "R", ["k"]).orderBy("n")
    rows = ids.collect()
    assert [r.n for r in rows] == [f"R{i:06d}" for i in range(1, 3001)]
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_ids_beyond_the_width_are_not_cut(spark):
    ids = model.assign_ids(spark.range(12), "n", "P", ["id"], width=1)
    assert {"P9", "P10", "P12"} <= {r.n for r in ids.collect()}


def test_dim_date_of_two_years(spark):
    dates = model.dim_date(spark, "2023-01-01", "2024-12-31")
    assert dates.count() == 731 and len(dates.columns) == 11
    row = dates.filter("date = '2024-12-29'").first()
    assert row.day_of_week == "Sunday" and row.is_weekend and row.week_number == 52
    assert (row.quarter_label, row.year_quarter, row.year_month, row.month_name) == ("Q4", "2024-Q4", "2024-12", "December")


def test_products_must_agree(spark):
    flat = flat_rows(spark, {}, {"selling_price": "41.00"})
    with pytest.raises(Exception, match="selling_price varies within product"):
        model.products_dim(flat).collect()


def test_orphans_per_foreign_key(spark, star):
    assert {r.orphan_rows for r in model.orphan_counts(star).collect()} == {0}
    extra = flat_rows(spark, {"product": "Unknown", "date": dt.date(2030, 1, 1)}, {"product": None})
    broken = model.Star(
        extra.select(*star.creative.columns),
        star.performance.withColumn("row_id", F.concat(F.lit("X"), "row_id")),
        star.revenue,
        star.products,
        star.dates,
    )
    found = {r.foreign_key: (r.orphan_keys, r.orphan_rows) for r in model.orphan_counts(broken).collect()}
    assert found == {
        "ad_creative.product": (1, 1),
        "ad_creative.date": (1, 1),
        "ad_performance.row_id": (3, 3),
        "revenue.row_id": (1, 1),
    }


def test_fanout_is_found_and_repaired(star):
    """A duplicated child inflates the view; the first generated id survives."""
    copies = star.performance.filter("row_id = 'R2'").withColumn("performance_id", F.lit("P000009"))
    more = copies.withColumn("performance_id", F.lit("P000008")).withColumn("spend", F.lit(99).cast("decimal(10,2)"))
    doubled = model.Star(
        star.creative, star.performance.union(copies).union(more), star.revenue, star.products, star.dates
    )
    assert model.fanout(doubled.performance, "row_id").collect() == [("R2", 3)]
    assert model.view_fanout(doubled).collect() == [("R2", 3)]
    assert master.performance_master(doubled).count() == 5

    repaired = model.keep_first(doubled.performance, "row_id", "performance_id")
    assert repaired.columns == doubled.performance.columns
    assert repaired.exceptAll(star.performance).count() == 0 and repaired.count() == 3


def test_keep_first_prefers_a_key_over_none(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "P2", 2), ("b", None, 3)], "k string, p string, v int")
    assert sorted((r.k, r.v) for r in model.keep_first(df, "k", "p").collect()) == [("a", 2), ("b", 3)]


def test_reconcile(star):
    counts = model.reconcile({"a": star.creative, "b": star.products})
    assert {r.source: r.row_count for r in counts.collect()} == {"a": 3, "b": 2}


def test_facts_join_only_what_is_asked_for(star):
    plan = star.facts("platform", "spend")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (row_id") == 1 and "revenue" not in plan
    assert star.facts("platform", "spend").columns == ["platform", "spend"]
    assert star.facts("platform", "roas", "year").count() == 3


def test_masters_have_the_published_columns(star):
    performance, profit = master.performance_master(star), master.profitability_master(star)
    assert len(performance.columns) == 48 + 2 and len(profit.columns) == 29 + 6
    row = performance.filter("row_id = 'R1'").first()
    assert row.creative_combination == "Story | Lifestyle | Casual | Video | UGC"
    assert row.scalability_decision == "Scale"
    row = profit.filter("row_id = 'R1'").first()
    assert (row.profit_status, row.ceo_recommendation) == ("Break-Even", "Optimise")
    assert (str(row.discount_leakage_pct), str(row.revenue_retention_pct)) == ("5.00", "87.50")
    assert str(row.roas_vs_breakeven_gap) == "3.00"


def test_combination_is_null_if_a_part_is(spark):
    rows = flat_rows(spark, {"copy_tone": None}, {"has_ugc": None}).select(master.creative_combination().alias("c"))
    assert [r.c for r in rows.collect()] == [None, "Story | Lifestyle | Casual | Video | Non UGC"]


@pytest.mark.parametrize("sent", [model.SENT_KEYS, 0])
def test_keep_first_shuffles_only_repeated_keys(spark, monkeypatch, sent):
    monkeypatch.setattr(model, "SENT_KEYS", sent)
    rows = spark.range(400).select(
        F.when(F.col("id") % 40 != 0, F.col("id") % 300).alias("k"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 101).alias("p"),
        F.col("id").alias("v"),
    )
    rows = rows.unionByName(rows.filter("v % 5 = 0"))
    found, expected = model.keep_first(rows, "k", "p"), model.collapse(rows, "k", "p")
    assert found.count() == expected.count() == rows.select("k").distinct().count()
    assert found.exceptAll(expected).isEmpty()
    alone, *collapsed = found._jdf.queryExecution().executedPlan().toString().split("Aggregate", 1)
    assert ("LeftAnti" in alone) == bool(sent) and "Exchange hashpartitioning" not in alone and "Exchange hashpartitioning" in collapsed[0]
