"""Exact top-k search by inner product: ball trees over shards, searched branch and bound."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import stored
from spendlens.llm.vectors import collapse, ranked, usable

#: Vectors of a shard, queries of a block, and vectors of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 16_384, 1_024, 128
#: Trees that a task takes in turn, and blocks that each of them meets there.
RUN_TREES, GROUP_BLOCKS = 4, 16
#: What a task takes together: a run of trees and a group of blocks of one vector size.
RUN = ("dim", "run", "grp")
#: Below any score; marks a place that no vector has taken yet.
NONE = np.iinfo(np.int64).min
#: Products up to here are exact in doubles.
EXACT = 1 << 53


class BallTree:
    """Vectors in leaf order and the balls that hold them; ball 0 holds all, children follow."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.spans, self.children, self.centres, self.radii = [], [], [], []
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        waiting = [(0, len(ids), None)]
        while waiting:
            a, b, parent = waiting.pop()
            ball = len(self.spans)
            if parent is not None:
                self.children[parent].append(ball)
            points = self.vectors[a:b].astype(np.float64)
            centre = points.mean(axis=0)
            self.spans.append((a, b))
            self.children.append([])
            self.centres.append(centre)
            self.radii.append(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
            if b - a <= LEAF_ROWS or self.radii[-1] == 0:
                continue
            # Split where the points spread along the line from the farthest of the centre to the farthest of that.
            one = points[((points - centre) ** 2).sum(axis=1).argmax()]
            two = points[((points - one) ** 2).sum(axis=1).argmax()]
            along = np.argsort(points @ (two - one), kind="stable")
            self.ids[a:b], self.vectors[a:b] = self.ids[a:b][along], self.vectors[a:b][along]
            half = (a + b) // 2
            waiting += [(half, b, ball), (a, half, ball)]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best for each query, ties to the smaller id; NONE where there are fewer.

        A ball is left out where its upper bound, the product with its centre
        plus radius times length of the query, is below the k-th score so far,
        or below ``floor``, a k-th score that is known from elsewhere.
        """
        wide = queries.astype(np.float64)
        length = np.sqrt((wide**2).sum(axis=1))
        bounds = wide @ self.centres.T + length[:, None] * self.radii
        bounds += 1e-9 * (np.abs(bounds) + length[:, None] * (1 + np.abs(self.centres).max(initial=0)))
        largest = np.abs(self.vectors).max(initial=0).astype(object) * np.abs(queries).max(initial=0).astype(object) * queries.shape[1]
        scores = np.full((len(queries), k), NONE, np.int64)
        ids = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        bar = floor.astype(np.float64)
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            ball, active = waiting.pop()
            active = active[bounds[active, ball] >= bar[active]]
            if not len(active):
                continue
            if below := self.children[ball]:
                # Each query goes first to the child with the higher bound; what is pushed last is searched first.
                left, right = below
                leftward = bounds[active, left] >= bounds[active, right]
                for first, second, own in ((left, right, active[leftward]), (right, left, active[~leftward])):
                    if len(own):
                        waiting += [(second, own), (first, own)]
                continue
            a, b = self.spans[ball]
            if largest < EXACT:
                fresh = (wide[active] @ self.vectors[a:b].astype(np.float64).T).astype(np.int64)
            else:
                fresh = np.einsum("qd,xd->qx", queries[active], self.vectors[a:b])
            both = np.concatenate([scores[active], fresh], axis=1)
            names = np.concatenate([ids[active], np.broadcast_to(self.ids[a:b], fresh.shape)], axis=1)
            order = np.lexsort((names, -both.astype(np.float64) if largest < EXACT else ~both), axis=1)[:, :k]
            scores[active] = np.take_along_axis(both, order, axis=1)
            ids[active] = np.take_along_axis(names, order, axis=1)
            bar[active] = np.maximum(bar[active], np.where(scores[active, -1] == NONE, -np.inf, scores[active, -1].astype(np.float64)))
        return ids, scores


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column("v").combine_chunks()
    return table.column("vid").to_numpy(), lists.flatten().to_numpy().reshape(table.num_rows, -1)


def _plant(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row for a shard: its tree."""
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": [key[1].as_py()], "tree": [pickle.dumps(BallTree(*_matrix(table)))]})


def _bundle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row for a block of queries: their ids, vectors and floors, none known yet."""
    ids, vectors = _matrix(table)
    floor = np.full(len(ids), -np.inf)
    queries = pickle.dumps((ids, vectors, floor))
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": [key[1].as_py()], "queries": [queries]})


def _search(k: int, raised: bool):
    """Searches trees, each followed by the blocks that meet it, sharing k-th scores along a task's runs.

    ``raised``: gives the blocks anew with the floors found, beside the answers.
    """

    def searched(batches):
        run, floors, at_tree, tree = None, {}, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, part, group, shard, block, data = (batch.column(n)[row].as_py() for n in (*RUN, "shard", "block", "data"))
                if run != (dim, part, group):  # rows come sorted by run, so floors of one run are held at a time
                    run, floors, at_tree, tree = (dim, part, group), {}, None, None
                if block is None:
                    at_tree, tree = shard, pickle.loads(data)
                    continue
                assert at_tree == shard, "a block came without its tree"
                qids, vectors, floor = pickle.loads(data)
                floor = np.maximum(floor, floors.get(block, floor))
                ids, scores = tree.search(vectors, k, floor)
                kth = scores[:, -1]
                floors[block] = floor = np.maximum(floor, np.where(kth == NONE, -np.inf, kth.astype(np.float64)))
                at, place = np.nonzero(scores != NONE)
                answers = {"qvid": qids[at], "cvid": ids[at, place], "score": scores[at, place]}
                yield pa.RecordBatch.from_pydict(
                    {
                        "dim": pa.array([dim], pa.int32()),
                        "block": [block],
                        "queries": [pickle.dumps((qids, vectors, floor)) if raised else b""],
                        "found": pa.array([[dict(zip(answers, x)) for x in zip(*(v.tolist() for v in answers.values()))]], _FOUND),
                    }
                )

    return searched


def _met(blocks: DataFrame, trees: DataFrame, k: int, raised: bool) -> DataFrame:
    """What ``blocks`` (dim, at, shard, block, queries) find in the trees of their shards; ``at`` is the shard's place among all.

    Trees and blocks are rows of their own in one stream. A run of trees meets a
    group of blocks: each tree of the run comes once, ahead of the blocks, one
    tree is open at a time, and both sides of a task are bounded.
    """
    run, group = F.floor(F.col("at") / RUN_TREES).alias("run"), F.floor(F.col("block") / GROUP_BLOCKS).alias("grp")
    asking = blocks.select("dim", run, group, "shard", "block", F.col("queries").alias("data"))
    wanted = blocks.select("dim", run, group, "shard").distinct()
    planted = wanted.join(trees, ["dim", "shard"]).select(*RUN, "shard", F.lit(None).cast("long").alias("block"), F.col("tree").alias("data"))
    # NULL comes first in a sort, so a tree precedes its blocks.
    rows = planted.unionByName(asking).repartition(*RUN).sortWithinPartitions(*RUN, "shard", "block")
    return rows.mapInArrow(_search(k, raised), _RESULT)


_FOUND = pa.list_(pa.struct([("qvid", pa.int64()), ("cvid", pa.int64()), ("score", pa.int64())]))
_RESULT = "dim int, block long, queries binary, found array<struct<qvid: long, cvid: long, score: long>>"


def quantised(vector: Column, scale: int = 256) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest integer inner product for each of ``queries``.

    Exact, ties to the smaller id; a query's own id is no answer. Rows with a
    NULL id take no part, nor do vectors that are NULL or empty or hold NULL or
    non-finite components. Repeated rows count once. Queries meet vectors of
    their own size only. Scores are exact as long as they fit 64 bits.

    Equal vectors are one entry. Distinct vectors are dealt into shards of
    bounded size, each with a ball tree, and queries into blocks of bounded size.
    Every block first searches one shard; the k-th scores found there are the
    floors with which it meets all other shards, and rise along a task. A tree is
    sent once for ``GROUP_BLOCKS`` blocks, never beside each of them.
    """
    ok = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(
        F.col("id").isNotNull() & usable(F.col("v"))
    )
    ints = lambda df: ok(df).select("id", quantised(F.col("v")).alias("v"))
    distinct = stored(collapse(ints(rows), k), "vectors")
    known = stored(
        ints(queries).distinct().join(distinct.select("vid", "v"), "v").select("id", F.col("vid").alias("qvid")), "asked"
    )
    asking = distinct.select("vid", "v").join(known.select(F.col("qvid").alias("vid")).distinct(), "vid")

    def dealt(df: DataFrame, rows_each: int, name: str) -> DataFrame:
        """Each vector with its shard or block, of about ``rows_each`` vectors, by a hash of its id."""
        counts = df.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / rows_each).alias("parts"))
        sized = df.select("vid", "v", F.size("v").alias("dim")).join(counts, "dim")
        return sized.select("dim", F.pmod(F.xxhash64("vid"), "parts").alias(name), "vid", "v")

    trees = dealt(distinct, SHARD_ROWS, "shard").groupBy("dim", "shard").applyInArrow(_plant, "dim int, shard long, tree binary")
    trees = stored(trees, "trees")
    blocks = dealt(asking, BLOCK_ROWS, "block").groupBy("dim", "block").applyInArrow(_bundle, "dim int, block long, queries binary")
    # A shard without vectors has no tree, so shards are numbered by those there are.
    numbers = trees.groupBy("dim").agg(F.array_sort(F.collect_list("shard")).alias("all"))
    blocks = blocks.join(numbers, "dim")
    blocks = blocks.withColumn("home", F.pmod("block", F.size("all")))
    home = blocks.select("dim", "block", "queries", F.col("home").alias("at"), F.get("all", F.col("home").cast("int")).alias("shard"))
    first = stored(_met(home, trees, k + 1, True), "first")
    others = first.select("dim", "block", "queries").join(numbers, "dim").select("dim", "block", "queries", F.posexplode("all").alias("at", "shard"), "all")
    others = others.filter(F.col("at") != F.pmod("block", F.size("all")))
    rest = _met(others, trees, k + 1, False)
    found = first.select(F.inline("found")).unionByName(rest.select(F.inline("found")))
    return ranked(found, distinct, known, k, F.col("score").desc())
