import glob
import os
import re

import pytest

from hand import SF, facts_rows, flat_rows
from spendlens import catalog, session
from spendlens.operators import clean, master, profile
from spendlens.plans import rollup
from spendlens.schemas import RAW
from spendlens.session import shared_path
from spendlens.sources import bound, files


def test_bound_row_ids_are_unique(facts):
    assert facts.count() == facts.select("row_id").distinct().count() == 6000


def test_raw_round_trip_through_csv(spark, raw):
    path = shared_path(spark, "csv")
    raw.write.option("header", True).csv(path)
    back = files.load_raw(spark, path)
    assert all(r._bad is None for r in back.collect())
    back = back.drop("_bad")
    assert [f.dataType for f in back.schema] == [f.dataType for f in RAW]
    assert back.exceptAll(raw).count() == 0 and back.count() == raw.count()


def test_a_bad_line_is_kept(spark, tmp_path):
    header = ",".join(RAW.fieldNames())
    good = ["R1", "2024-01-01"] + ["x"] * 9 + ["1"] * 27
    bad = ["R2", "no date"] + good[2:]
    (tmp_path / "raw.csv").write_text("\n".join([header, ",".join(good), ",".join(bad)]) + "\n")
    rows = {r.row_id: r for r in files.load_raw(spark, str(tmp_path)).collect()}
    assert rows["R1"]._bad is None and rows["R2"]._bad.startswith("R2,no date")
    assert rows["R2"].date is None and rows["R2"].platform == "x"


def test_snapshot_versions_are_immutable(spark):
    path, df = shared_path(spark, "snap"), flat_rows(spark, {}, {})
    assert files.snapshot(df, path, 1).exceptAll(df).count() == 0
    with pytest.raises(Exception, match="already exists"):
        files.snapshot(df, path, 1)
    assert files.snapshot(df.limit(1), path, 2).count() == 1


def test_published_master_prunes_partitions(spark):
    rows = master.performance_columns(facts_rows(spark, {}, {"date": __import__("datetime").date(2023, 5, 1)}))
    published = files.publish_master(rows, shared_path(spark, "master"))
    assert published.schema.fieldNames() == rows.schema.fieldNames()
    assert published.exceptAll(rows).count() == 0 and published.count() == 2
    plan = published.filter("year = 2023")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and published.filter("year = 2023").count() == 1


def test_scan_by_path_and_name(spark):
    files.scan(spark, f"{SF}/region.parquet").createOrReplaceTempView("regions")
    assert files.scan(spark, "regions").count() == 5


def test_preview_is_ordered(spark):
    assert [r.id for r in files.preview(spark.range(9).repartition(4), 2, ["id"]).collect()] == [0, 1]


def test_mess_is_as_described(raw):
    assert raw.select("platform").distinct().count() == 12 and raw.select("product").distinct().count() == 16
    tagged = clean.count_tagged_dups(raw).first().duplicate_rows
    assert raw.count() == 6000 + tagged and tagged > 0
    assert bound.raw(raw.sparkSession, SF).schema.fieldNames() == RAW.fieldNames()


def test_stored_flat_follows_its_input(spark, tmp_path):
    for table in ("lineitem", "orders"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    every = catalog.stored_flat(spark, str(tmp_path)).count()
    reads = len(catalog.STORE_READS)
    assert catalog.stored_flat(spark, str(tmp_path)).count() == every and len(catalog.STORE_READS) == reads + 1
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(50).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert 0 < catalog.stored_flat(spark, str(tmp_path)).count() < every and len(catalog.STORE_READS) == reads + 1


def test_stored_flat_keeps_narrow_rows_only(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_STORED", {})
    monkeypatch.setattr(catalog, "BUCKET_INPUT", 20_000)  # bytes of input for a bucket
    stored, flat = catalog.stored_flat(spark, SF), bound.flat(spark, SF)
    assert stored.schema.fieldNames() == flat.schema.fieldNames()
    assert [f.dataType for f in stored.schema] == [f.dataType for f in flat.schema]
    assert stored.exceptAll(flat).count() == 0 and stored.count() == flat.count()
    ((_, name),) = catalog._STORED.values()
    assert not {"spend", "campaign_name", "net_profit"} & set(spark.table(name).columns)
    shuffled = next(l for l in bound.narrow(spark, SF, 7)._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in l)
    assert "7)" in shuffled and "concat(C" in shuffled  # the text of the id is not shuffled beside its parts
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert int(described["Num Buckets"]) > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize(
    "step",
    [
        lambda raw, facts: raw,
        lambda raw, facts: clean.clean(raw),
        lambda raw, facts: clean.violations(clean.impute_mean(raw)),
        lambda raw, facts: profile.sketch(raw),
        lambda raw, facts: rollup.states(facts),
    ],
    ids=["raw", "clean", "violations", "profile", "rollup"],
)
def test_the_jvm_compiles_the_code_of_the_campaign_rows(spark, raw, facts, step, capsys):
    """Under any session's settings: no method of whole-stage code passes the 8000 bytecodes of the JVM."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.maxPlanStringLength": str(1 << 29)}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        capsys.readouterr()
        step(raw, facts).select("*").explain("codegen")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", capsys.readouterr().out)]
    assert sizes and 0 < min(sizes) and max(sizes) <= 8000


def test_compressed_csv_comes_back_whole_in_bounded_files(spark, raw):
    path, some = shared_path(spark, "csv"), spark.createDataFrame(raw.filter("hook_rate is null").limit(25).collect(), raw.schema).coalesce(1)
    files.store_csv(some, path, rows=10)
    names = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(names) == 3 and all(n.endswith(".csv.gz") for n in names)
    back = files.load_raw(spark, path)
    assert all(r._bad is None for r in back.collect())
    assert sorted(map(str, back.drop("_bad").collect())) == sorted(map(str, some.collect()))
    catalog.QUERIES["S1_load_raw"](spark, SF)
    export = max(glob.glob(f"{session.shared_folder(spark)}/raw-csv-*"), key=os.path.getmtime)
    assert all(n.endswith(".csv.gz") for n in os.listdir(export) if n.startswith("part-"))
