import pytest
from decimal import Decimal as D

from pyspark.sql import functions as F

from hand import flat_rows
from spendlens.functions.text import spellings
from spendlens.operators import clean
from spendlens.schemas import FLAT, RAW_COLUMNS


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_clean_undoes_the_mess(raw, facts):
    """Clean rows equal the facts but for the imputed rates."""
    rates = ["hook_rate", "completion_rate"]
    kept = [c for c in FLAT.fieldNames() if c not in (*rates, "frequency_at_fatigue")]
    cleaned = clean.clean(raw)
    assert cleaned.select(kept).exceptAll(facts.select(kept)).count() == 0
    assert facts.select(kept).exceptAll(cleaned.select(kept)).count() == 0
    assert cleaned.filter("hook_rate is null or completion_rate is null").count() == 0
    assert cleaned.filter("cpa is null").count() == facts.filter("cpa is null").count()


def test_null_audit_and_unexpected_nulls(spark):
    df = flat_rows(spark, {"hook_rate": None}, {"cpa": None, "spend": None}, {}, {})
    audit = by(clean.null_audit(df), "column")
    assert audit["hook_rate"].nulls == 1 and audit["hook_rate"].null_share == D("0.25")
    assert audit["reach"].nulls == 0 and len(audit) == len(FLAT)
    assert [r.column for r in clean.unexpected_nulls(df).collect()] == ["spend"]


def test_drop_tagged_dups_keeps_lookalikes(spark):
    df = flat_rows(spark, {"row_id": "Adup"}, {"row_id": "R1_dup"}, {"row_id": "R2"})
    assert {r.row_id for r in clean.drop_tagged_dups(df).collect()} == {"Adup", "R2"}
    assert {r.row_id for r in clean.drop_tagged_dups(df, exact_like=True).collect()} == {"R2"}
    assert clean.count_tagged_dups(df).first().duplicate_rows == 1


def test_standardise_leaves_and_reports_unknown_values(spark):
    df = flat_rows(spark, {"platform": "TIKTOK"}, {"platform": "Snap"}, {"platform": "snap "}, {"platform": None})
    mapping = spellings(("Meta", "TikTok"))
    assert [r.platform for r in clean.standardise(df, "platform", mapping).collect()] == ["TikTok", "Snap", "snap ", None]
    assert clean.unmapped(df, "platform", mapping).collect() == [("snap", 2)]


def test_imputed_rate_can_break_a_rule_and_is_reported(spark):
    df = flat_rows(spark, {"hook_rate": "0.1000", "hold_rate_3s": "0.0500"}, {"hook_rate": None, "hold_rate_3s": "0.1500"})
    filled = clean.impute_mean(df, ["hook_rate"])
    rows = by(filled, "row_id")
    assert rows["R2"].hook_rate == D("0.1000") and rows["R2"].hook_rate_imputed
    assert not rows["R1"].hook_rate_imputed
    broken = by(clean.validate(filled), "rule")
    assert broken["hold_below_hook"].broken_rows == 1
    assert clean.violations(filled).select("row_id", "broken_rules").collect() == [("R2", ["hold_below_hook"])]


def test_impute_skips_cpa(spark):
    df = flat_rows(spark, {"cpa": None}, {"cpa": "5.00"})
    assert clean.impute_mean(df, ["cpa"]).filter("cpa is null").count() == 1


def test_calculated_columns(spark):
    df = flat_rows(
        spark,
        {},
        {"selling_price": "30.00", "impressions": 0, "fatigue_score": None, "roas": None},
    ).select(*RAW_COLUMNS)
    rows = by(clean.enrich(df, flag_nulls=True), "row_id")
    one, two = rows["R1"], rows["R2"]
    assert one.breakeven_roas == D("4.0000") and one.contribution_margin == D("10.00")
    assert one.net_profit == D("0.00") and one.funnel_dropoff_rate == D("0.002")
    assert one.fatigue_status == "Low Fatigue" and one.performance_category == "Extreme Winner"
    assert two.breakeven_roas is None and two.funnel_dropoff_rate is None
    assert two.fatigue_status == "High Fatigue" and two.fatigue_status_is_null_input
    assert two.performance_category == "Obvious Loser" and two.performance_category_is_null_input


def test_identities_catch_a_wrong_metric(spark):
    df = flat_rows(spark, {}, {"roas": "9.0000"}, {"ctr": None})
    found = by(clean.check_identities(df), "identity")
    assert found["roas"].mismatches == 1 and found["roas"].largest_gap == D("2.000000")
    assert found["ctr"].one_sided_nulls == 1 and found["net_revenue"].mismatches == 0


def test_profiles(spark):
    df = flat_rows(spark, {"platform": "meta"}, {}, {"spend": "2.50"})
    cats = {(r["column"], r.value): r["rows"] for r in clean.profile_categories(df).collect()}
    assert cats[("platform", "meta")] == 1 and cats[("platform", "Meta")] == 2 and cats[("has_ugc", "1")] == 3
    ranges = by(clean.profile_ranges(df, approx_distinct=True), "column")
    assert (ranges["spend"].min_value, ranges["spend"].max_value) == (2.5, 10.0)
    assert ranges["spend"].approx_distinct == 2


@pytest.mark.parametrize("rule", ["spend_not_negative", "frequency_at_least_1", "roas_below_max", "ctr_in_0_1"])
def test_each_rule_can_fail(spark, rule):
    bad = {"spend": "-1.00", "frequency": "0.50", "roas": "10.0000", "ctr": "1.2000"}
    column = next(c for c in bad if rule.startswith(c))
    found = by(clean.validate(flat_rows(spark, {column: bad[column]}, {})), "rule")
    assert found[rule].broken_rows == 1
    assert sum(r.broken_rows for r in found.values()) == 1


def test_rows_without_an_id_are_no_duplicates(spark):
    rows = flat_rows(spark, {"row_id": "A"}, {"row_id": "B_dup"}).select("row_id", "spend")
    rows = rows.unionByName(rows.limit(1).withColumn("row_id", F.lit(None).cast("string")))
    assert sorted(str(r.row_id) for r in clean.drop_tagged_dups(rows).collect()) == ["A", "None"]


def test_violations_are_filtered_where_the_rules_are_computed(spark, raw):
    """Pushed further down, the rules would be computed twice, from the source columns spelled out."""
    plan = clean.violations(clean.impute_mean(raw))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert any("broken_rules" in line for line in filters) and not any("hold_below_hook" in line for line in filters)
