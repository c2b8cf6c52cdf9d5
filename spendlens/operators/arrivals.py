"""Tables that grow: ids that continue, and arrivals merged into what is stored."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import COMPACT, child_names, move_files, path_exists, remove_path
from .model import collapse, in_places, nth, part

_MARKS, _LOADS = "marks", "loads"
#: Keys are counted in so many slots; a slot with more rows than ``HEAVY`` may hold a key with very many copies.
SLOTS, HEAVY = 1 << 16, 1_000_000
#: Folder of a batch's new rows inside a merged table; Spark's readers skip names that begin so.
_ARRIVED = "_arrived"
_MARK = "last_number long, _load int, _part long, _start long, _format string, id_column string"


def _finished_loads(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("load=")) for n in child_names(spark, f"{path}/{_MARKS}") if n.startswith("load="))


def _marks(spark: SparkSession, path: str, loads: Sequence[int]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/{_MARKS}/load={n}" for n in loads])


def _stored_loads(spark: SparkSession, path: str, loads: Sequence[int]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{_LOADS}/load={n}" for n in loads])


def numbered(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows numbered so far, or None before the first load.

    A load holds its rows with their places; the mark says which number each part of the sort begins with.
    """
    loads = _finished_loads(spark, path)
    if not loads:
        return None
    marks, columns = _marks(spark, path, loads), ("_load", "_part", "_start", "_format")
    known = marks.select(*columns).filter("_load is not null") if "_load" in marks.columns else None
    placed = sorted(r._load for r in known.select("_load").distinct().collect()) if known is not None else []
    older = [n for n in loads if n not in placed]
    # Loads of earlier versions hold the ids themselves.
    found = [_stored_loads(spark, path, older)] if older else []
    if placed:
        rows = _stored_loads(spark, path, placed)
        number = F.printf("_format", F.col("_start") + nth()).alias(marks.filter("_load is not null").first().id_column)
        rest = [c for c in rows.columns if c not in ("_load", "_slot")]
        met = rows.withColumn("_part", part()).join(F.broadcast(known), ["_load", "_part"])
        found.append(met.select(number, *rest))
    return reduce(DataFrame.unionByName, found)


def high_water(spark: SparkSession, path: str) -> int:
    """The last number given, from the mark of the last finished load."""
    loads = _finished_loads(spark, path)
    return spark.read.parquet(f"{path}/{_MARKS}/load={loads[-1]}").first().last_number if loads else 0


def continue_ids(
    df: DataFrame, path: str, id_column: str, prefix: str, key: str, order_by: Sequence[str], width: int = 6, parts: int | None = None
) -> DataFrame:
    """Number the rows of ``df`` whose ``key`` is not stored yet, after the last number given; return all numbered rows.

    Rows that are stored keep their ids, whatever ``df`` says of them now, so a
    load that is repeated adds nothing and the rows of a first load are numbered
    as by ``assign_ids`` alone. New rows are numbered in the order of
    ``order_by``; of several new rows with one key each gets a number. A NULL
    key is never known, so its row is new in every load.

    Each load is a folder of its own, followed by a mark with its last number and
    the first number of each part of its sort, from which ``numbered`` gives the
    ids: the rows are written once. A load without a mark was cut off and is
    written again. Only one load may run at a time. ``parts`` as in ``in_places``.
    """
    spark, loads = df.sparkSession, _finished_loads(df.sparkSession, path)
    last, load = high_water(spark, path), (loads or [0])[-1] + 1
    arrived = df
    if loads:
        known = _stored_loads(spark, path, loads).select(key).distinct()
        arrived = df.join(known, key, "left_anti").select(*df.columns)
    target = f"{path}/{_LOADS}/load={load}"
    placed = in_places(arrived, order_by, parts=parts).withColumn("_load", F.lit(load))
    placed.write.mode("overwrite").options(**COMPACT).parquet(target)
    # One row per part of the sort, so never more than the number of shuffle partitions.
    sizes = spark.read.parquet(target).groupBy(part().alias("_part")).agg(F.count("*").alias("_size")).collect()
    if sizes:
        starts, count = [], 0
        for place, size in sorted(sizes):
            starts.append((load, place, last + count + 1, f"{prefix}%0{width}d", id_column))
            count += size
        mark = spark.createDataFrame([(last + count, *s) for s in starts], _MARK).coalesce(1)
        mark.write.mode("overwrite").parquet(f"{path}/{_MARKS}/load={load}")
    else:
        remove_path(spark, target)
    found = numbered(spark, path)
    return spark.createDataFrame([], f"{id_column} string").join(df.limit(0)) if found is None else found


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The rows of a table that ``merge_arrivals`` keeps."""
    return spark.read.parquet(path).select(*columns)


def _by_bucket(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", _bucket(key, buckets)).hint("rebalance", "_bucket")


def _cell(key: str, buckets: int, parts: int) -> Column:
    """A part of a bucket, ``parts`` of them in each: rows of a bucket lie in its own partitions only."""
    hashed = F.xxhash64(key)
    part = F.pmod(F.xxhash64(F.lit(3), hashed), F.lit(parts))  # hashed anew: the bucket is a remainder of the first hash
    return (F.pmod(hashed, F.lit(buckets)) * parts + part).cast("int")


def _thinned(batch: DataFrame, key: str, by: str) -> DataFrame:
    """``batch``, in which keys with very many copies are collapsed, so that a key's rows can gather in one task."""
    slot = F.pmod(F.xxhash64(F.lit(4), key), F.lit(SLOTS))
    counted = batch.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_rows"))
    heavy = [r._slot for r in counted.filter(F.col("_rows") > HEAVY).collect()]
    if not heavy:
        return batch
    return batch.filter(~slot.isin(heavy)).unionByName(collapse(batch.filter(slot.isin(heavy)), key, by))


def merge_arrivals(batch: DataFrame, path: str, key: str, by: str, buckets: int = 256) -> DataFrame:
    """Merge ``batch`` into the table at ``path``: one row per ``key``, the one with the smallest ``by``.

    The table lies in folders by a hash of the key. Folders in which no stored
    row is beaten keep their files, and get files of their new rows beside them;
    those in which a row of the batch beats a stored one are read and written
    again. Repeats inside the batch and against the table collapse by the rule
    of ``keep_first``, so merging a batch again changes nothing and the order of
    batches does not matter. ``buckets`` holds for the table's whole life.

    The batch is shuffled once, into parts of the buckets, where it is collapsed
    and meets the stored keys, each with its ``by``. The rows that win are written to a folder inside the table which readers skip, and
    moved from there. A merge that is cut off leaves one row a key, or buckets
    that the next merge of the batch completes; only one may run at a time. The
    first batch makes the table.
    """
    spark, columns = batch.sparkSession, batch.columns
    cells = math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / buckets)

    def in_cells(rows: DataFrame, name: str, of: str) -> DataFrame:
        return rows.withColumn(name, _cell(of, buckets, cells)).repartitionById(buckets * cells, F.col(name))

    mine = collapse(in_cells(_thinned(batch, key, by), "_cell", key), key, by, "_cell")
    if not path_exists(spark, path):
        first = mine.select(*columns, _bucket(key, buckets).alias("_bucket"))
        first.write.options(**COMPACT).partitionBy("_bucket").parquet(path)
        return stored_rows(spark, path, columns)
    schema = batch.withColumn("_bucket", _bucket(key, buckets)).schema
    # Never more than `buckets` numbers reach the driver; they select the folders to be read.
    met = [r._bucket for r in batch.select(_bucket(key, buckets).alias("_bucket")).distinct().collect()]
    stored = spark.read.schema(schema).parquet(path).filter(F.col("_bucket").isin(met))
    ranked = F.struct(F.col(by).isNull().alias("m"), F.col(by))
    held = in_cells(stored.select(F.col(key).alias("_key"), ranked.alias("_held")), "_at", "_key")
    compared = mine.join(held, (F.col("_cell") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    wins = F.col("_held").isNull() | (ranked < F.col("_held"))
    beats = F.when(F.col("_held").isNotNull(), _bucket(key, buckets))
    arrived, watch = f"{path}/{_ARRIVED}", Observation()
    won = compared.filter(wins).observe(watch, F.collect_set(beats).alias("beaten")).withColumn("_bucket", _bucket(key, buckets))
    won.select(*columns, "_bucket").write.mode("overwrite").options(**COMPACT).partitionBy("_bucket").parquet(arrived)
    beaten = list(watch.get.get("beaten") or [])
    if beaten:
        new = spark.read.schema(schema).parquet(arrived).filter(F.col("_bucket").isin(beaten))
        kept = stored.filter(F.col("_bucket").isin(beaten))
        known = new.select(F.col(key).alias("_key"))
        kept = kept.join(known, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        merged = _by_bucket(kept.unionByName(new).select(*columns), key, buckets).write.mode("overwrite").options(**COMPACT)
        merged.option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    for folder in child_names(spark, arrived):
        if "=" in folder and int(folder.split("=")[1]) not in beaten:
            move_files(spark, f"{arrived}/{folder}", f"{path}/{folder}")
    remove_path(spark, arrived)
    return stored_rows(spark, path, columns)
