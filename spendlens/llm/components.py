"""Connected components of an edge table, without the driver seeing any edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import dealt_join, dropped, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = dealt_join(both, least, "a", "b").filter(F.col("b") > F.col("a"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie each node's smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = dealt_join(edges, least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node.

    Alternates large and small stars until the edges stop changing, which takes
    a number of rounds logarithmic in the longest path. Each round is written to
    the shared folder, so no round depends on the lineage of the one before. The
    edges of a hub are dealt to several tasks where they meet its smallest node.
    """
    links = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(links, "edges"), None
    for _ in range(max_rounds):
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before, last = digest, now
        now = stored(_small_star(_large_star(last)), "edges")
        dropped(last)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
