"""Mergeable profile of a table: exact ranges, and sketches for distinct values and quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import NUMERIC_COLUMNS

#: Registers of a distinct sketch, as a power of two, and size of a quantile sketch.
HLL_LG_K, KLL_K = 12, 200
#: Relative error of distinct counts (three standard errors) and rank error of quantiles, at these sizes.
HLL_ERROR, KLL_ERROR = 0.05, 0.027


def sketch(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """One row per column: rows, filled rows, exact range, and two sketches. One pass, bounded state per task."""

    def figures(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.struct(
            F.lit(name).alias("column"),
            F.count("*").alias("rows"),
            F.count(name).alias("filled_rows"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            F.hll_sketch_agg(F.col(name).cast("string"), HLL_LG_K).alias("distinct_sketch"),
            F.kll_sketch_agg_double(value, KLL_K).alias("quantile_sketch"),
        )

    return df.agg(F.array(*[figures(c) for c in columns]).alias("f")).select(F.inline("f"))


def store(df: DataFrame, path: str, version: int, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Write the profile of a snapshot beside it, under ``path/_profile/version=n``, and return it."""
    target = f"{path}/_profile/version={version}"
    sketch(df, columns).coalesce(1).write.mode("errorifexists").parquet(target)
    return df.sparkSession.read.parquet(target)


def merged(spark: SparkSession, path: str, versions: Sequence[int] | None = None) -> DataFrame:
    """The profile of several snapshots' rows together, from their stored profiles alone."""
    folders = [f"{path}/_profile/version={v}" for v in versions] if versions else [f"{path}/_profile/*"]
    stored = spark.read.parquet(*folders)
    return stored.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("filled_rows").alias("filled_rows"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def read(profile: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Readable profile: ``approx_distinct`` and one column per quantile, NULL where a column has no value."""
    some = F.col("filled_rows") > 0
    ranks = [
        F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(q)))).alias(f"q{round(q * 100)}")
        for q in quantiles
    ]
    return profile.select(
        "column", "rows", "filled_rows", "min_value", "max_value",
        F.hll_sketch_estimate("distinct_sketch").alias("approx_distinct"), *ranks,
    )
