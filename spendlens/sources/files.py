"""Sources and sinks: raw CSV, stored tables, versioned snapshots, the published master."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import digests
from ..schemas import RAW
from ..session import COMPACT, path_exists, remove_path

CORRUPT_COLUMN = "_bad"
#: Folder of the partition digests inside a published data set; Spark's readers skip names that begin so.
DIGESTS = "_digests"
#: Most rows of a compressed CSV file: some 60 MB of text in an export of 38 columns.
CSV_ROWS = 200_000


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """Read the 38-column CSV export as it came, with declared types.

    A line that does not fit the schema is given whole in a last column
    ``_bad``, which is NULL for the others: a date or number that could not be
    read is NULL, but never without a trace. Every column is read as nullable,
    since a file can break any rule.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in RAW])
    schema = schema.add(CORRUPT_COLUMN, T.StringType(), True)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .csv(path)
    )


def store_csv(df: DataFrame, path: str, codec: str = "gzip", rows: int = CSV_ROWS) -> None:
    """Write ``df`` as compressed CSV with a header, which ``load_raw`` reads.

    A compressed file is read by one task, so none gets more than ``rows`` rows.
    """
    options = {"header": True, "compression": codec, "maxRecordsPerFile": rows, "zlib.compress.level": "BEST_SPEED"}
    df.write.options(**options).csv(path)


def scan(spark: SparkSession, table_or_path: str) -> DataFrame:
    """Whole table: a catalog name, or a Parquet path if it holds a slash."""
    if "/" in table_or_path:
        return spark.read.parquet(table_or_path)
    return spark.table(table_or_path)


def snapshot(df: DataFrame, path: str, version: int) -> DataFrame:
    """Write an immutable copy under ``path/version=n`` and return it as read back.

    Fails if that version exists; a new state is a new version.
    """
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").options(**COMPACT).parquet(target)
    return df.sparkSession.read.parquet(target)


def store_in_buckets(df: DataFrame, path: str, key: str, buckets: int | None = None, laid: bool = False) -> str:
    """Write ``df`` to ``path`` in hash buckets of ``key``, each one sorted file; give the name of the table.

    The table is known to this session's catalog. Tables, or columns of one, in
    as many buckets join on ``key`` where they lie. ``buckets`` is the number of
    shuffle partitions if not given: the one shuffle that every later join saves.
    ``laid``: the rows are hashed into so many partitions by ``key`` already.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (df if laid else df.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key)
    rows.options(**COMPACT).option("path", path).format("parquet").saveAsTable(name)
    return name


def read_master(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The published data set, with the columns and types of ``schema``."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def publish_master(
    df: DataFrame, path: str, by: tuple[str, ...] = ("year", "quarter"), rebalance: bool = True
) -> DataFrame:
    """Write the curated data set partitioned by the slicer columns; fails if there is one.

    The rebalance hint lets Spark join small outputs and split a quarter that
    holds most of the rows over several tasks and files. Without ``rebalance``
    the rows are written where they lie, for input that is arranged already.
    """
    rows = df.hint("rebalance", *by) if rebalance else df
    rows.write.mode("errorifexists").partitionBy(*by).parquet(path)
    return read_master(df.sparkSession, path, df.schema)


def partition_digests(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per value of ``by``: row count and two sums of row hashes, which don't depend on the order.

    The hashes cover the names and types of the columns too, so that another
    shape of the same figures is another content.
    """
    columns = sorted(c for c in df.columns if c not in by)
    shape = F.lit(df.select(*columns).schema.simpleString())
    return digests(df, [F.col(c) for c in by], columns, shape)


def _known_digests(df: DataFrame, by: Sequence[str]) -> dict[tuple, tuple]:
    """Digests by values of ``by``: one row per partition folder, as many as the driver lists to read the data set."""
    names = [*by, "rows", "digest_a", "digest_b"]
    # All at once: an iterator runs a job for each partition, one after the other.
    return {tuple(r[: len(by)]): tuple(r[len(by) :]) for r in df.select(*names).collect()}


def _stored_digests(df: DataFrame, path: str, by: Sequence[str]) -> DataFrame:
    spark, known = df.sparkSession, f"{path}/{DIGESTS}"
    if path_exists(spark, known):
        return spark.read.parquet(known)
    return partition_digests(read_master(spark, path, df.schema), by)


def _differing(now: dict[tuple, tuple], before: dict[tuple, tuple]) -> tuple[list[tuple], list[tuple]]:
    return [k for k in now if now[k] != before.get(k)], [k for k in before if k not in now]


def changed_partitions(df: DataFrame, path: str, by: Sequence[str]) -> tuple[list[tuple], list[tuple]]:
    """Values of ``by`` whose stored content differs from ``df``, and those that ``df`` no longer has.

    Reads the digests that the last refresh left, or the stored rows where there are none.
    """
    return _differing(_known_digests(partition_digests(df, by), by), _known_digests(_stored_digests(df, path, by), by))


def refresh_master(
    df: DataFrame, path: str, by: tuple[str, ...] = ("year", "quarter"), rebalance: bool = True, laid: DataFrame | None = None
) -> DataFrame:
    """Bring the published data set to the content of ``df``, rewriting only partitions that differ.

    Partitions of equal content keep their files, so their readers see nothing
    of it; those that ``df`` lacks go. The first call publishes. ``df`` is read
    twice, for its digests and for what changed. ``rebalance`` as in ``publish_master``.
    ``laid``: the same rows arranged for the writer, who writes them where they
    lie. Digests don't need that order, and are not held to a task a partition by it.

    The digests kept beside the data go first and come back last: a refresh that
    is cut off leaves none, and the next one compares the stored rows instead.
    """
    spark = df.sparkSession
    arranged = df if laid is None else laid.select(*df.columns)
    rebalance = rebalance and laid is None
    if not path_exists(spark, path):
        return publish_master(arranged, path, by, rebalance)
    digested = partition_digests(df, by)
    now = _known_digests(digested, by)
    changed, gone = _differing(now, _known_digests(_stored_digests(df, path, by), by))
    if changed or gone:
        remove_path(spark, f"{path}/{DIGESTS}")
    if changed:
        rows = arranged.filter(reduce(Column.__or__, [_at(by, values) for values in changed]))
        rows = rows.hint("rebalance", *by) if rebalance else rows
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for values in gone:
        remove_path(spark, f"{path}/{_folder(spark, by, values)}")
    published = read_master(spark, path, df.schema)
    if not path_exists(spark, f"{path}/{DIGESTS}"):
        # What was compared above: ``df`` is not read again for it.
        known = spark.createDataFrame([(*k, *v) for k, v in now.items()], digested.schema)
        known.write.mode("overwrite").parquet(f"{path}/{DIGESTS}")
    return published


def _at(by: Sequence[str], values: Sequence) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, values)])


def _folder(spark: SparkSession, by: Sequence[str], values: Sequence) -> str:
    """Folder of a partition, named as Spark's writer names it."""
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join(named(c, None if v is None else str(v)) for c, v in zip(by, values))


def preview(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows; ordered by ``order_by`` so that the choice is repeatable."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
