"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts are handed to Python in slices of about so many characters.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    only_ascii = F.octet_length(text) == F.length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def wide_hash(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they stand for the values."""
    return [F.xxhash64(F.lit(0), *columns), F.xxhash64(F.lit(1), *columns)]


def dealt_join(rows: DataFrame, known: DataFrame, key: str, by: str, salts: int = 8) -> DataFrame:
    """Inner join of ``rows`` with ``known``, one row a ``key``, the rows of a key dealt to ``salts`` tasks by ``by``.

    Both sides are shuffled for it, so adaptive execution can split a hot key
    further; an aggregate between shuffle and join would stop it from that.
    """
    salt = F.pmod(F.xxhash64(F.lit(5), by), F.lit(salts)).cast("int")
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", salt).join(copies, [key, "salt"]).drop("salt")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor costs no more than reading the table again. The table stays
    until ``dropped`` removes it or the folder is cleaned.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove what ``stored`` wrote for ``df``, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(conf).delete(path, True)


def slices(texts: list, limit: int = SLICE_CHARS):
    """Index ranges whose texts hold about ``limit`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
