"""What keeps results up to date: refresh, diff, audit, continued ids, merged arrivals, rollup, profile."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from hand import SF, facts_rows, flat_rows
from spendlens import catalog, session
from spendlens.functions.numeric import STATES
from spendlens.operators import arrivals, audit, clean, diff, master, model, profile
from spendlens.plans import kpis, rollup, trends
from spendlens.session import shared_path
from spendlens.sources import bound, files


def parts(path):
    """Data files by folder, with their modification times."""
    found = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.startswith("part-"):
                found.setdefault(os.path.relpath(folder, path), {})[n] = os.stat(f"{folder}/{n}").st_mtime_ns
    return {k: v for k, v in found.items() if "=" in k or not k.startswith("_")}


def plan(df):
    conf = df.sparkSession.conf
    conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.unset("spark.sql.debug.maxToStringFields")


def executed(spark, job):
    """Final physical plans of what ``job`` runs."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(20_000)
    before = store.executionsList().size()
    job()
    bus.waitUntilEmpty(20_000)
    listed = store.executionsList()
    return [listed.apply(i).physicalPlanDescription() for i in range(before, listed.size())]


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# --- refresh of the published master -------------------------------------


@pytest.fixture
def quarters(spark):
    """A frame of master rows: three quarters, one of them without a quarter number."""
    days = [dt.date(2023, 2, 1), dt.date(2023, 5, 1), dt.date(2023, 5, 2), dt.date(2024, 8, 1)]
    rows = master.performance_columns(facts_rows(spark, *[{"date": d} for d in days]))
    return rows.withColumn("quarter", F.when(F.col("year") == 2023, F.col("quarter")))


def test_refresh_rewrites_only_what_changed(spark, quarters):
    path = shared_path(spark, "master")
    assert same(files.refresh_master(quarters, path), quarters)
    first = parts(path)
    assert set(first) == {"year=2023/quarter=1", "year=2023/quarter=2", "year=2024/quarter=__HIVE_DEFAULT_PARTITION__"}
    assert files.changed_partitions(quarters.repartition(3), path, ("year", "quarter")) == ([], [])
    changed = quarters.withColumn("spend", F.when(F.col("row_id") == "R2", F.col("spend") + 1).otherwise(F.col("spend")).cast("decimal(10,2)"))
    assert files.changed_partitions(changed, path, ("year", "quarter")) == ([(2023, 2)], [])
    assert same(files.refresh_master(changed, path), changed)
    second = parts(path)
    differing = {k for k in second if second[k] != first[k]}
    assert differing == {"year=2023/quarter=2"}
    assert same(files.refresh_master(changed, path), changed) and parts(path) == second


def test_refresh_adds_and_removes_partitions(spark, quarters):
    path = shared_path(spark, "master")
    files.refresh_master(quarters, path)
    first = parts(path)
    come = quarters.filter("row_id = 'R1'").withColumn("year", F.lit(2025))
    now = quarters.filter("year = 2023").unionByName(come)
    assert files.changed_partitions(now, path, ("year", "quarter")) == ([(2025, 1)], [(2024, None)])
    assert same(files.refresh_master(now, path), now)
    second = parts(path)
    assert set(second) == {"year=2023/quarter=1", "year=2023/quarter=2", "year=2025/quarter=1"}
    assert all(second[k] == first[k] for k in second if k in first)
    nothing = now.limit(0)
    assert files.refresh_master(nothing, path).count() == 0 and parts(path) == {}


def test_refresh_after_one_that_was_cut_off(spark, quarters):
    path = shared_path(spark, "master")
    files.refresh_master(quarters, path)
    session.remove_path(spark, f"{path}/{files.DIGESTS}")  # what a refresh does first
    half = quarters.filter("year = 2023 and quarter = 2").limit(1)
    half.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "quarter").parquet(path)
    assert files.changed_partitions(quarters, path, ("year", "quarter")) == ([(2023, 2)], [])
    assert same(files.refresh_master(quarters, path), quarters)


def test_digests_see_moved_values_and_types(spark):
    def digest(sql):
        return files.partition_digests(spark.sql(sql), ["k"]).collect()

    base = digest("select 1 k, 'x' a, cast(null as string) b")
    assert base != digest("select 1 k, cast(null as string) a, 'x' b")
    assert digest("select 1 k, 5 a") != digest("select 1 k, 5L a") and digest("select 1 k, 5 a") != digest("select 1 k, 5 c")
    assert digest("select 1 k, a from values (1), (2), (2) t(a)") == digest("select 1 k, a from values (2), (1), (2) t(a)")
    assert digest("select 1 k, a from values (1), (1), (2) t(a)") != digest("select 1 k, a from values (2), (1), (2) t(a)")


def test_refresh_reads_its_rows_twice(spark, quarters):
    path = shared_path(spark, "master")
    files.refresh_master(quarters, path)
    source = shared_path(spark, "source")
    changed = quarters.withColumn("clicks", F.when(F.col("row_id") == "R2", 77).otherwise(F.col("clicks")).cast("long"))
    changed.write.parquet(source)
    rows = spark.read.schema(quarters.schema).parquet(source)
    plans = executed(spark, lambda: files.refresh_master(rows, path, rebalance=False))
    assert sum(p.count(source.rsplit("/", 1)[-1]) for p in plans) == 2
    assert not any("REBALANCE" in p for p in plans) and same(files.read_master(spark, path, quarters.schema), rows)
    assert files.changed_partitions(rows, path, ("year", "quarter")) == ([], [])


def test_refresh_compares_in_one_job_without_the_writers_layout(spark, quarters):
    path = shared_path(spark, "master")
    files.refresh_master(quarters, path)
    laid = quarters.hint("rebalance", "year", "quarter").sortWithinPartitions("year", "quarter")
    changed = lambda df: df.withColumn("clicks", F.when(F.col("row_id") == "R2", 77).otherwise(F.col("clicks")).cast("long"))
    plans = executed(spark, lambda: files.refresh_master(changed(quarters), path, laid=changed(laid)))
    assert ["REBALANCE" in p for p in plans].count(True) == 1 and ["xxhash64" in p and "REBALANCE" in p for p in plans].count(True) == 0
    assert same(files.read_master(spark, path, quarters.schema), changed(quarters))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else few rows are joined into one partition
    spark.sparkContext.setJobGroup("known digests", "")
    try:
        files._known_digests(files.partition_digests(quarters, ["year", "quarter"]), ["year", "quarter"])
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("known digests")) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# --- diff of snapshots ---------------------------------------------------


def changes(df):
    return {r.row_id: (r.change, r.changed_columns, r.rows_before, r.rows_after) for r in df.collect()}


def test_diff_lists_keys_and_columns(spark):
    before = flat_rows(spark, {}, {}, {}, {"cpa": None}, {"row_id": None}, {})
    after = before.filter("row_id is null or row_id != 'R1'").withColumns(
        {
            "spend": F.when(F.col("row_id") == "R2", F.lit(99)).otherwise(F.col("spend")).cast("decimal(10,2)"),
            "platform": F.when(F.col("row_id") == "R2", "Other").when(F.col("row_id").isNull(), "None").otherwise(F.col("platform")),
            "cpa": F.when(F.col("row_id") == "R4", 0).when(F.col("row_id") == "R3", None).otherwise(F.col("cpa")).cast("decimal(10,2)"),
        }
    )
    after = after.unionByName(before.filter("row_id = 'R6'")).unionByName(flat_rows(spark, {"row_id": "new"}))
    expected = {
        "R1": ("removed", None, 1, 0),
        "R2": ("changed", "platform,spend", 1, 1),
        "R3": ("changed", "cpa", 1, 1),
        "R4": ("changed", "cpa", 1, 1),
        "R6": ("changed", "rows", 1, 2),
        "new": ("added", None, 0, 1),
        None: ("changed", "platform", 1, 1),
    }
    for buckets in (1, 4, 4096):
        assert changes(diff.snapshot_diff(before, after, "row_id", buckets)) == expected
    assert changes(diff.snapshot_diff(before, before.repartition(3), "row_id")) == {}
    assert set(changes(diff.snapshot_diff(before.limit(0), after.filter("row_id = 'R3'"), "row_id"))) == {"R3"}
    with pytest.raises(ValueError, match="columns differ"):
        diff.snapshot_diff(before, after.drop("spend"), "row_id")


def test_equal_buckets_are_not_joined(spark, facts):
    flat = facts.select("row_id", "spend", "clicks")
    later = flat.withColumn("clicks", F.when(F.col("row_id") == flat.first().row_id, -1).otherwise(F.col("clicks")))
    assert len(diff.differing_buckets(flat, later, ["row_id"], 64)) == 1
    found = diff.snapshot_diff(flat, later, "row_id", 64)
    text = plan(found)
    # Below the full join, each side is filtered to the differing buckets before anything is shuffled by key.
    assert "FullOuter" in text and text.count("FileScan parquet [l_") == 2
    for scan in re.finditer(r"FileScan parquet \[l_", text):
        above = text[: scan.start()]
        assert above.rindex("pmod(xxhash64(") > above.rindex("Exchange hashpartitioning(row_id")
    assert found.count() == 1
    none = diff.snapshot_diff(flat, flat, "row_id", 64)
    assert none.count() == 0 and "FullOuter" not in plan(none)


def test_diff_joins_only_differing_keys(spark, monkeypatch):
    before = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("row_id"), (F.col("id") % 7).alias("a"), F.lit("x").alias("b"))
    later = before.withColumn("a", F.when(F.col("row_id").isin("k5", "k700"), -1).otherwise(F.col("a")))
    later = later.filter("row_id != 'k9'").unionByName(before.filter("row_id = 'k11'"))
    keys = diff.differing_keys(before, later, ["row_id"])
    assert keys.distinct().count() == keys.count() == 4
    expected = {"k5": ("changed", "a", 1, 1), "k700": ("changed", "a", 1, 1), "k9": ("removed", None, 1, 0), "k11": ("changed", "rows", 1, 2)}
    for sent in (diff.SENT_KEYS, 0):
        monkeypatch.setattr(diff, "SENT_KEYS", sent)
        found = diff.snapshot_diff(before, later, "row_id", 1)  # one bucket: every row lies in a bucket that differs
        assert changes(found) == expected and "LeftSemi" in plan(found)
    two = before.select(F.when(F.col("a") > 3, F.col("a")).alias("p"), F.when(F.col("a") <= 3, F.col("a")).alias("q"), "b")
    assert diff.snapshot_diff(two, two.withColumn("b", F.when(F.col("q") == 2, "y").otherwise("x")), ["p", "q"], 4).count() == 1


def test_differing_keys_shuffle_once(spark):
    before = spark.range(300).select((F.col("id") % 200).alias("k"), (F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, 1).alias("b"))
    # Two copies that both change, a value that becomes NULL, a row that goes.
    later = before.withColumns({"a": F.when(F.col("k") == 7, 9).otherwise(F.col("a")), "b": F.when(F.col("k") == 8, None).otherwise(F.col("b"))})
    later = later.filter("k != 150")
    keys = diff.differing_keys(before, later, ["k"])
    assert plan(keys.select("_key")).count("Exchange hashpartitioning") == 1
    assert {r._key for r in keys.collect()} == {r.h for r in spark.range(200).withColumnRenamed("id", "k").filter("k in (7, 8, 150)").select(diff._key_hash(["k"]).alias("h")).collect()}


def test_query_of_the_diff_reads_its_first_snapshot(spark, monkeypatch):
    def none(*_):
        raise AssertionError("the campaigns are written as a snapshot, not stored in buckets before")

    expected = {"removed", "added", "changed"}
    monkeypatch.setattr(catalog, "stored_flat", none)
    plans = executed(spark, lambda: expected.difference_update(r.change for r in catalog.QUERIES["M8_snapshot_diff"](spark, SF).collect()))
    assert sum(len(re.findall(r"Location: [^\n]*lineitem", p)) for p in plans) == 1 and not expected


# --- audit beside the write ----------------------------------------------


def test_audit_equals_the_separate_operators(spark, raw):
    stored, report = audit.audited_snapshot(raw, shared_path(spark, "snap"), 1)
    unique = clean.drop_tagged_dups(raw)
    assert same(stored, unique)
    got = {(r.report, r.item, r.figure): r.value for r in report.collect()}
    for r in clean.null_audit(raw).collect():
        assert got.pop(("nulls", r["column"], "nulls")) == r.nulls
    for r in clean.validate(unique).collect():
        assert got.pop(("rules", r.rule, "broken_rows")) == r.broken_rows
        assert got.pop(("rules", r.rule, "unchecked_rows")) == r.unchecked_rows
    for r in clean.check_identities(unique).collect():
        for figure in ("checked_rows", "mismatches", "one_sided_nulls", "largest_gap"):
            assert got.pop(("identities", r.identity, figure)) == pytest.approx(float(r[figure]), abs=1e-9)
    assert got == {
        ("rows", "raw", "rows"): raw.count(),
        ("rows", "tagged_duplicates", "rows"): clean.count_tagged_dups(raw).first().duplicate_rows,
        ("rows", "written", "rows"): unique.count(),
    }


def test_audit_reads_the_export_once(spark, raw):
    executions = spark._jsparkSession.sharedState().statusStore()
    before = executions.executionsList().size()
    audit.audited_snapshot(raw, shared_path(spark, "snap"), 1)[1].count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    listed = executions.executionsList()
    plans = [listed.apply(i).physicalPlanDescription() for i in range(before, listed.size())]
    # The description of a plan names the location of each of its scans once.
    assert sum(len(re.findall(r"Location: [^\n]*lineitem", p)) for p in plans) == 1


def test_audit_of_nothing(spark, raw):
    stored, report = audit.audited_snapshot(raw.limit(0), shared_path(spark, "snap"), 1)
    got = {(r.report, r.item, r.figure): r.value for r in report.collect()}
    assert stored.count() == 0 and got["rows", "raw", "rows"] == 0 and got["identities", "roas", "largest_gap"] is None


# --- ids that continue ---------------------------------------------------


def ids(df):
    return {r.k: r.n for r in df.select("k", "n").collect()}


def test_ids_continue_without_gap_or_repeat(spark):
    path = shared_path(spark, "ids")
    rows = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") * 7 % 1000).alias("o"), F.lit("x").alias("t"))

    def load(df):
        return arrivals.continue_ids(df, path, "n", "P", "k", ["o"], width=3)

    first = ids(load(rows.filter("k < 300").repartition(5)))
    alone = model.assign_ids(rows.filter("k < 300"), "n", "P", ["o"], width=3)
    assert first == ids(alone)
    second = ids(load(rows.repartition(7)))
    assert {k: second[k] for k in first} == first
    assert sorted(int(v[1:]) for v in second.values()) == list(range(1, 1001))
    order = sorted((k for k in second if k >= 300), key=lambda k: k * 7 % 1000)
    assert [int(second[k][1:]) for k in order] == list(range(301, 1001))
    files_before = parts(path)
    assert ids(load(rows)) == second and parts(path) == files_before
    assert arrivals.high_water(spark, path) == 1000


def test_a_load_that_was_cut_off_is_written_again(spark):
    path = shared_path(spark, "ids")
    rows = spark.range(10).select(F.col("id").alias("k"))
    arrivals.continue_ids(rows.filter("k < 4"), path, "n", "P", "k", ["k"])
    arrivals.continue_ids(rows, path, "n", "P", "k", ["k"])
    session.remove_path(spark, f"{path}/marks/load=2")
    assert arrivals.numbered(spark, path).count() == 4
    done = arrivals.continue_ids(rows, path, "n", "P", "k", ["k"])
    assert sorted(int(r.n[1:]) for r in done.collect()) == list(range(1, 11))


def test_ids_of_no_rows_and_of_null_keys(spark):
    path, rows = shared_path(spark, "ids"), spark.createDataFrame([(None, 1), (5, 2), (5, 3)], "k long, v int")
    assert arrivals.continue_ids(rows.limit(0), path, "n", "P", "k", ["v"]).columns == ["n", "k", "v"]
    assert arrivals.continue_ids(rows, path, "n", "P", "k", ["v"]).count() == 3
    assert arrivals.continue_ids(rows, path, "n", "P", "k", ["v"]).count() == 4  # the NULL key is new each time


def test_a_load_is_written_once_and_older_loads_are_read(spark):
    path = shared_path(spark, "ids")
    rows = spark.range(60).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    model.assign_ids(rows.filter("k < 9"), "n", "P", ["k"]).write.parquet(f"{path}/loads/load=1")  # as loads were stored before
    spark.range(1).select(F.lit(9).cast("long").alias("last_number")).write.parquet(f"{path}/marks/load=1")
    assert ids(arrivals.numbered(spark, path)) == {k: f"P{k + 1:06d}" for k in range(9)}
    handed = len(session._HANDED_OUT[spark.sparkContext.applicationId])
    for upto in (30, 60):
        done = arrivals.continue_ids(rows.filter(F.col("k") < upto).repartition(3), path, "n", "P", "k", ["k"])
        assert ids(done) == {k: f"P{k + 1:06d}" for k in range(upto)} and done.columns == ["n", "k", "t"]
    assert len(session._HANDED_OUT[spark.sparkContext.applicationId]) == handed  # no copy but the load itself


# --- arrivals merged -----------------------------------------------------


def test_merge_rewrites_only_touched_buckets(spark):
    path = shared_path(spark, "merged")
    rows = spark.range(400).select(F.col("id").alias("k"), (F.col("id") + 1000).alias("p"), F.lit("old").alias("t"))
    merge = lambda df: arrivals.merge_arrivals(df, path, "k", "p", buckets=16)
    assert same(merge(rows), rows)
    first = parts(path)
    assert len(first) == 16
    batch = spark.createDataFrame([(7, 5, "new"), (7, 6, "newer"), (9, 5000, "late"), (None, 3, "none"), (None, 2, "less")], "k long, p long, t string")
    expected = model.keep_first(rows.unionByName(batch), "k", "p")
    assert same(merge(batch), expected)
    second = parts(path)
    touched = {r.b for r in spark.createDataFrame([(7,), (None,)], "k long").select(arrivals._bucket("k", 16).alias("b")).collect()}
    assert {k for k in second if second[k] != first.get(k)} == {f"_bucket={b}" for b in touched}
    assert same(merge(batch), expected) and parts(path) == second
    assert same(merge(rows), expected) and parts(path) == second


def test_merge_in_any_order_equals_keep_first(spark):
    rows = spark.range(600).select((F.col("id") % 90).alias("k"), F.when(F.col("id") % 50 != 0, F.col("id") * 37 % 601).alias("p"), F.col("id").alias("v"))
    expected = model.keep_first(rows, "k", "p")
    for turns in ((0, 1, 2), (2, 0, 1)):
        path = shared_path(spark, "merged")
        for turn in turns:
            done = arrivals.merge_arrivals(rows.filter(F.col("v") % 3 == turn), path, "k", "p", buckets=8)
        assert same(done, expected)


def test_merge_collapses_whole_rows_once(spark):
    path = shared_path(spark, "merged")
    rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") + 1000).alias("p"), F.lit("wide").alias("t"))
    arrivals.merge_arrivals(rows, path, "k", "p", buckets=4)
    batch = rows.filter("k % 3 = 0").withColumn("p", F.col("p") - 500).unionByName(rows.withColumn("k", F.col("k") + 150))
    plans = executed(spark, lambda: arrivals.merge_arrivals(batch, path, "k", "p", buckets=4))
    # Keys and their smallest p first; whole rows only where they are written.
    assert [("_first" in p or "_missing" in p) for p in plans if "Aggregate" in p].count(True) == 1
    assert same(arrivals.stored_rows(spark, path, rows.columns), model.keep_first(rows.unionByName(batch), "k", "p"))


def test_merge_keeps_the_files_of_buckets_without_a_beaten_row(spark):
    path = shared_path(spark, "merged")
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") + 1000).alias("p"), F.lit("old").alias("t"))
    merge = lambda df: arrivals.merge_arrivals(df, path, "k", "p", buckets=8)
    merge(rows)
    first = parts(path)
    batch = rows.filter("p < 1200").unionByName(rows.withColumns({"k": F.concat("k", F.lit("-new")), "t": F.lit("new")}))
    batch = batch.unionByName(batch.filter("p % 3 = 0").withColumn("p", F.col("p") + 9000))
    batch = batch.unionByName(spark.createDataFrame([("k7", 5, "beats"), ("k7", 6, "late"), ("k8", None, "none")], "k string, p long, t string"))
    plans = executed(spark, lambda: merge(batch))
    assert same(arrivals.stored_rows(spark, path, rows.columns), model.collapse(rows.unionByName(batch), "k", "p"))
    second = parts(path)
    (beaten,) = [f"_bucket={r.b}" for r in spark.createDataFrame([("k7",)], "k string").select(arrivals._bucket("k", 8).alias("b")).collect()]
    assert all(set(first[b].items()) < set(second[b].items()) for b in first if b != beaten) and not set(first[beaten]) & set(second[beaten])
    # The batch meets the stored keys in the parts of its buckets: whole rows are shuffled once, and laid so.
    (met,) = [p for p in plans if "direct_shuffle_partition_id" in p and "_arrived" in p]
    assert "REBALANCE" not in met
    assert same(merge(batch), model.collapse(rows.unionByName(batch), "k", "p")) and parts(path) == second
    assert same(merge(batch.limit(0)), model.collapse(rows.unionByName(batch), "k", "p")) and not os.path.exists(f"{path}/_arrived")


def test_narrow_rows_are_numbered_as_the_wide_ones(spark, tmp_path):
    lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    other = lines.limit(700).withColumn("l_tax", F.col("l_tax") + 0.01)  # other figures under an id that is there already
    other.unionByName(lines).unionByName(lines.limit(300)).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    plans = executed(spark, lambda: catalog.performance_with_repeats(spark, str(tmp_path)))
    shuffled = [line for p in plans for line in p.split("\n\n") if "Exchange" in line and "rangepartitioning" in line]
    assert shuffled and not any("impressions" in line or "cpm" in line for line in shuffled)
    wide = model.with_performance_id(clean.enrich(bound.raw(spark, str(tmp_path))).select(*catalog.PERFORMANCE_COLUMNS))
    assert same(catalog.performance_with_repeats(spark, str(tmp_path)), catalog._untagged(wide))


def test_merge_collapses_keys_with_very_many_copies_before_they_gather(spark, monkeypatch):
    path = shared_path(spark, "merged")
    rows = spark.range(900).select(F.when(F.col("id") > 299, "often").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("k"), (F.col("id") * 7 % 901).alias("p"), "id")
    monkeypatch.setattr(arrivals, "HEAVY", 100)
    thin = arrivals._thinned(rows, "k", "p")
    assert thin.filter("k = 'often'").count() == 1 and thin.filter("k != 'often'").count() == 300
    for batch in (rows.filter("id % 2 = 0"), rows):
        done = arrivals.merge_arrivals(batch, path, "k", "p", buckets=4)
        assert same(done, model.collapse(batch, "k", "p"))
    monkeypatch.setattr(arrivals, "HEAVY", 1000)
    whole = plan(arrivals._thinned(rows, "k", "p"))
    assert "Exchange" not in whole and "Aggregate" not in whole


# --- star in buckets -----------------------------------------------------


def test_masters_join_buckets_without_shuffle_or_sort(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = catalog.star(spark, SF)
        joined = star.creative.join(star.performance, "row_id").join(star.revenue, "row_id")
        text = plan(joined)
        assert text.count("SortMergeJoin") == 2 and "Exchange" not in text and "Sort [" not in text
        for name in ("V1_performance_master", "V2_profitability_master"):
            whole = plan(catalog.QUERIES[name](spark, SF))
            assert "hashpartitioning(row_id" not in whole and whole.count("SortMergeJoin [row_id") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_master_rows_count_the_view(spark):
    star = catalog.star(spark, SF)
    assert model.master_rows(star).first().row_count == master.performance_master(star).count()
    twice = model.Star(star.creative, star.performance.unionByName(star.performance.limit(7)), star.revenue, star.products.filter("product <> 'Yoga Mat'"), star.dates)
    assert model.master_rows(twice).first().row_count == master.performance_master(twice).count()


def test_drop_stored(spark):
    path = shared_path(spark, "throwaway")
    spark.range(3).write.parquet(path)
    kept = session._HANDED_OUT[spark.sparkContext.applicationId]
    session._HANDED_OUT[spark.sparkContext.applicationId] = [path]
    try:
        assert session.drop_stored(spark) == 1 and not session.path_exists(spark, path)
    finally:
        session._HANDED_OUT[spark.sparkContext.applicationId] = kept


# --- rollup --------------------------------------------------------------


@pytest.mark.parametrize(
    "choice",
    [{}, {"year": [1996, 1997]}, {"month": 3}, {"platform": "TikTok"}, {"product": ["Yoga Mat", "Creatine"]}, {"ad_format": "Video"}, {"fatigue_status": "Low Fatigue"}],
    ids=lambda c: next(iter(c), "all"),
)
def test_rollup_answers_every_slicer(spark, facts, choice):
    states, rows = (kpis.slice_by(df, **choice) for df in (catalog.stored_rollup(spark, SF), facts))
    for question in (
        lambda df, **over: kpis.kpis(df, ["platform", "fatigue_status"], **over),
        lambda df, **over: kpis.awareness(df, **over),
        lambda df, **over: kpis.acquisition_cost(df, ["product", "ad_format"], **over),
        lambda df, **over: trends.mom(df, "ctr", ["platform"], **over),
        lambda df, **over: trends.quarter_trend(df, ["product"], **over),
    ):
        a, b = (catalog.present(question(df, **over)) for df, over in ((states, {"over": STATES}), (rows, {})))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert "lineitem" not in plan(a)


def test_rollup_merges_and_compacts(spark, facts):
    path, to = shared_path(spark, "rollup"), shared_path(spark, "rollup")
    rollup.add(facts.filter("day(date) < 9"), path)
    every = rollup.add(facts.filter("day(date) >= 9"), path)
    assert same(rollup.merge(every), rollup.merge(rollup.states(facts)))
    small = rollup.compact(spark, path, to)
    assert small.count() == rollup.states(facts).count() < every.count()
    by_year = rollup.merge(small, ("year",))
    exact = facts.groupBy("year").agg(F.min("cpa"), F.max("cpa"), F.count("hook_rate"), F.sum("spend"))
    assert sorted(by_year.select("year", "cpa_min", "cpa_max", "hook_rate_filled", "spend_sum").collect()) == sorted(exact.collect())


# --- profile -------------------------------------------------------------


def test_profile_merges_without_the_rows(spark, raw):
    path = shared_path(spark, "snap")
    columns = ["impressions", "cpa", "hook_rate", "spend"]
    for version, part in enumerate((raw.filter("day(date) < 9"), raw.filter("day(date) >= 9")), 1):
        profile.store(part, path, version, columns)
    merged = profile.merged(spark, path)
    assert "lineitem" not in plan(merged)
    exact = {r["column"]: r for r in clean.profile_ranges(raw, columns).collect()}
    rows = raw.count()
    for r in profile.read(merged, (0.1, 0.5, 0.9)).collect():
        name, e = r["column"], exact[r["column"]]
        assert (r.rows, r.filled_rows, r.min_value, r.max_value) == (rows, e.filled_rows, e.min_value, e.max_value)
        distinct = raw.select(name).filter(F.col(name).isNotNull()).distinct().count()
        assert abs(r.approx_distinct - distinct) <= max(1, profile.HLL_ERROR * distinct)
        for q in (10, 50, 90):
            below = raw.filter(F.col(name) < r[f"q{q}"]).count() / e.filled_rows
            upto = raw.filter(F.col(name) <= r[f"q{q}"]).count() / e.filled_rows
            assert below - profile.KLL_ERROR <= q / 100 <= upto + profile.KLL_ERROR
    assert [r.rows for r in profile.read(profile.merged(spark, path, [1])).collect()] == [raw.filter("day(date) < 9").count()] * 4


def test_profile_of_an_empty_column(spark):
    path = shared_path(spark, "snap")
    profile.store(flat_rows(spark, {"cpa": None}), path, 1, ["cpa", "spend"])
    found = {r["column"]: r for r in profile.read(profile.merged(spark, path)).collect()}
    assert (found["cpa"].filled_rows, found["cpa"].min_value, found["cpa"].q50, found["cpa"].approx_distinct) == (0, None, None, 0)
    assert found["spend"].q50 == 10.0


# --- crossing day, spelling ----------------------------------------------


def test_day_on_which_fatigue_reaches_the_cut(spark):
    def scores(ad, *pairs):
        return [{"ad_id": ad, "date": dt.date(2024, 1, day), "fatigue_score": score} for day, score in pairs]

    rows = facts_rows(
        spark,
        *scores("rising", (1, "1.0"), (3, "2.0"), (5, "3.0")),
        *scores("ahead", (1, "2.0"), (2, "2.3"), (2, "2.3")),
        *scores("passed", (1, "3.0"), (9, "7.0")),
        *scores("flat", (1, "2.0"), (4, "2.0")),
        *scores("falling", (1, "3.0"), (4, "2.0")),
        *scores("one", (1, "3.0"), (1, "5.0")),
        *scores("unscored", (1, None)),
        *scores("partly", (1, None), (2, "1.0"), (4, "2.0")),
    )
    found = {r.ad_id: (r.scored_rows, r.slope and float(r.slope), r.crossing_day, r.days_left) for r in kpis.leaving_low_fatigue(rows).collect()}
    assert found == {
        "rising": (3, 0.5, dt.date(2024, 1, 7), 2),
        "ahead": (3, 0.3, dt.date(2024, 1, 8), 6),
        "passed": (2, 0.5, dt.date(2024, 1, 3), -6),
        "flat": (2, 0.0, None, None),
        "falling": (2, -0.333333, None, None),
        "one": (2, None, None, None),
        "partly": (2, 0.5, dt.date(2024, 1, 8), 4),
    }


def test_spelling_proposals(spark):
    names = ["creatine", "Craetine", "creatin", "xcreatine", "cat", "bat ", "bta", "hta", "", None, "zzzzz", "rceatinee"]
    df = spark.createDataFrame([(n,) for n in names + ["Craetine"]], "product string")
    mapping = {"creatine": "Creatine", "cat": "Cat", "hat": "Hat", "rat": "Rat"}
    found = {}
    for r in clean.spelling_proposals(df, "product", mapping).collect():
        found.setdefault(r.unmapped_value, []).append((r.rows, r.proposal, r.distance, r.ties))
    assert {k: sorted(v, key=str) for k, v in found.items()} == {
        "craetine": [(2, "Creatine", 1, 1)],
        "creatin": [(1, "Creatine", 1, 1)],
        "xcreatine": [(1, "Creatine", 1, 1)],
        "bat": [(1, "Cat", 1, 3), (1, "Hat", 1, 3), (1, "Rat", 1, 3)],
        "bta": [(1, None, None, 0)],  # shares no first letter
        "hta": [(1, "Hat", 1, 1)],
        "": [(1, None, None, 0)],
        "zzzzz": [(1, None, None, 0)],
        "rceatinee": [(1, None, None, 0)],  # a swap and a letter are three edits
    }


def test_proposals_join_only_distinct_values(spark):
    text = plan(catalog.QUERIES["C5_proposals"](spark, SF))
    for scan in re.finditer(r"FileScan parquet \[l_", text):
        above = text[: scan.start()]
        # No value is dealt to its blocks before the rows are aggregated to distinct values.
        assert above.rindex("HashAggregate") > above.rfind("Generate explode(array_distinct(")
