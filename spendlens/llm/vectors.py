"""Distinct vectors and result rows, shared by the two searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither NULL nor empty, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def collapse(rows: DataFrame, k: int) -> DataFrame:
    """(vid, ids, v) for each distinct ``v`` of ``rows`` (id, v).

    ``vid`` is the vector's smallest id; ``ids`` its ``k + 1`` smallest, in
    order. No more of them can be among the ``k`` nearest of a query, whose own
    id is left out. Only so many copies of a vector leave a task.
    """
    first = W.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").distinct().withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "ids", "v")


def ranked(found: DataFrame, distinct: DataFrame, queries: DataFrame, k: int, best: Column) -> DataFrame:
    """(query_id, rank, vec_id, score) from the nearest vectors of each distinct query vector.

    ``found`` (qvid, cvid, score) holds at least the ``k + 1`` best of each;
    ``queries`` is (id, qvid). Copies are put in for their vector, the query's
    own id is left out, ties go to the smaller id.
    """
    order = W.partitionBy("qvid").orderBy(best, F.col("cvid"))
    near = found.distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    copies = near.join(distinct.select(F.col("vid").alias("cvid"), "ids"), "cvid").select("qvid", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("qvid").orderBy(best, F.col("vec_id"))
    rows = copies.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    lists = rows.groupBy("qvid").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    own_out = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    answers = queries.join(lists, "qvid").select(F.col("id").alias("query_id"), F.posexplode(own_out).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
