"""Physical plans: what is shuffled, broadcast and read."""

import re

import pytest

from hand import SF
from spendlens.catalog import QUERIES
from spendlens.operators import master
from spendlens.plans import awareness, decision, efficiency
from spendlens.sources import bound


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture()
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


WRITES = ("S1_", "S3_", "S4_", "M4_")


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(WRITES)])
def test_no_cross_join_and_no_raw_rows_in_one_task(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text
    lines = text.split("\n")
    for above, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in above:
            # Only partial aggregates (or already aggregated rows) may gather.
            assert "HashAggregate" in below or "Project" in below and "partial" in text, above


def test_questions_shuffle_once_after_the_base_join(spark, no_broadcast):
    for name in ("Q2_reach_by_platform", "Q12_scalability_matrix", "Q25_budget_recommendation"):
        text = plan(QUERIES[name](spark, SF))
        assert text.count("Exchange hashpartitioning") == 3  # two join sides, one aggregate
        assert "partial_" in text


def test_only_needed_columns_are_read(spark):
    text = plan(awareness.reach_by_platform(bound.facts(spark, SF)))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("l_quantity" in r and "l_discount" not in r and "l_linenumber" not in r for r in read)


def test_grand_total_costs_no_second_pass(spark):
    for question in (awareness.spend_verdict, decision.category_spend):
        assert final(question(bound.facts(spark, SF))).count("Scan parquet") == 2  # orders and lineitem


def test_fatigue_bands_aggregate_once(spark, no_broadcast):
    text = final(efficiency.fatigue_bands(bound.facts(spark, SF)))
    assert text.count("Scan parquet") == 2 and "ReusedExchange" in text
    assert text.count("SortMergeJoin") == 2  # the base join, and the ends of the chunks


def test_masters_read_the_stored_star(spark):
    for name in ("V1_performance_master", "V2_profitability_master"):
        assert plan(QUERIES[name](spark, SF)).count("lineitem.parquet") == 0


def test_no_query_changes_the_session(spark):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    for name in ("V1_performance_master", "S4_publish_master", "C4_null_audit", "M8_reconcile", "M4_assign_ids"):
        QUERIES[name](spark, SF)
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before


def test_long_lag_does_not_gather_a_platform(spark):
    text = plan(efficiency.fatigue_bands(bound.facts(spark, SF)))
    assert "hashpartitioning(platform#" in text
    windows = [l for l in text.split("\n") if "Window [" in l and "avg_roas" in l]
    assert windows and all("product" in l.split("],")[1] for l in windows)


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["Q4_scroll_stoppers"](spark, SF))


def test_masters_are_not_shuffled_by_product(spark):
    for name in ("V1_performance_master", "V2_profitability_master", "Q2_over_star"):
        text = plan(QUERIES[name](spark, SF))
        assert "hashpartitioning(product" not in text and "BroadcastHashJoin [product" in text


def test_masters_are_sorted_by_quarter_while_narrow(spark):
    rows = master.performance_columns(bound.facts(spark, SF, by_quarter=True))
    text = plan(rows)
    below = text[text.index("Sort [year") :]
    assert "Sort [year" not in below[1:] and "impressions" not in below and "impressions" in text
    assert rows.exceptAll(master.performance_columns(bound.facts(spark, SF))).count() == 0
