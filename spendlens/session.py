"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spendlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Campaign rows are wide: past 8000 bytecodes a method the JVM compiles no more,
        # and Spark should use its split projections instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Sorted buckets with one file each need no sort before a merge join.
        .config("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


#: Paths handed out under the shared folder, by application.
_HANDED_OUT: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path under the shared folder; ``drop_stored`` removes what lies there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Remove all that this session's queries stored in the shared folder; give the number of paths.

    Results of queries may still read what they stored: call it once they have
    been used. A later query stores anew what it needs.
    """
    paths = _HANDED_OUT.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove_path(spark, path)
    return len(paths)


#: How wide intermediate tables are written: they take a third less disk than by Spark's default codec.
COMPACT = {"compression": "zstd"}


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably: whatever was decided while writing (partition
    numbers, sampled range bounds) can no longer change on a recomputation.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**COMPACT).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def path_exists(spark: SparkSession, path: str) -> bool:
    system, found = _located(spark, path)
    return system.exists(found)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    system, found = _located(spark, path)
    system.delete(found, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in ``path``; none if it is not there."""
    system, found = _located(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(found)) if system.exists(found) else []


def move_files(spark: SparkSession, source: str, target: str) -> None:
    """Move the data files of folder ``source`` into folder ``target``, which is made if it is not there."""
    system, found = _located(spark, target)
    system.mkdirs(found)
    for name in child_names(spark, source):
        if not name.startswith((".", "_")) and not system.rename(_located(spark, f"{source}/{name}")[1], found):
            raise OSError(f"{source}/{name} could not be moved to {target}")
