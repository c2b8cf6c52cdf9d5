"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendlens.llm.common import stored
from spendlens.llm.vectors import collapse, ranked, usable

#: Vectors, and queries, that one task compares at most.
BASE_ROWS, QUERY_ROWS = 16_384, 4_096
#: Components that the sample of a vector size holds, vectors that it holds at least, and those of them that ask.
SAMPLE, SAMPLE_ROWS, SAMPLE_QUERIES = 1 << 20, 1_000, 256
#: Products of queries and axes that are held at a time.
HELD = 1 << 20


def rotations(dim: int, tables: int, seed: int) -> np.ndarray:
    """Signs of three diagonal flips for each table, over the next power of two dimensions."""
    padded = 1 << max(0, dim - 1).bit_length()
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(tables, 3, padded))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-random rotation: three rounds of sign flips and a fast Hadamard transform."""
    out = np.zeros((len(x), signs.shape[1]))
    out[:, : x.shape[1]] = x
    for flip in signs:
        out *= flip
        half = 1
        while half < out.shape[1]:
            parts = out.reshape(len(out), -1, 2, half)
            out = np.concatenate([parts[:, :, :1] + parts[:, :, 1:], parts[:, :, :1] - parts[:, :, 1:]], axis=2).reshape(len(out), -1)
            half *= 2
        out /= np.sqrt(out.shape[1])
    return out


def axes(rotated: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first; axis i + dim is the negative of i."""
    both = np.concatenate([rotated, -rotated], axis=1)
    probes = min(probes, both.shape[1])
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, axis=1), axis=1, kind="stable"), axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows."""
    out = x / np.abs(x).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def products(units: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Each row's product with the signed axes of every table; of a table's axes, i + dim is the negative of i."""
    turned = [rotate(units, s) for s in signs]
    return np.concatenate([y for x in turned for y in (x, -x)], axis=1)


def axis(units: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Each row's nearest signed axis in one table."""
    return axes(rotate(units, signs), 1)[:, 0]


def depth_for(x: np.ndarray, k: int, tables: int, recall: float, seed: int) -> int:
    """Axes, of all tables together, that a query has to probe to meet the given share of its ``k`` nearest.

    Measured: the first vectors of ``x`` ask for their exact nearest among all of
    ``x``. Denser tables, with nearer neighbours, are met more often still.
    """
    units, asking = unit(x), x[:SAMPLE_QUERIES]
    rough = (x * x).sum(axis=1) - 2 * asking @ x.T
    rough[np.arange(len(asking)), np.arange(len(asking))] = np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(rough, k - 1, axis=1)[:, :k]
    signs = rotations(x.shape[1], tables, seed)
    met = np.full(near.shape, np.iinfo(np.int64).max)
    order = np.argsort(-products(units[: len(asking)], signs), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    wide = order.shape[1] // tables
    for table in range(tables):
        met = np.minimum(met, np.take_along_axis(place, table * wide + axis(units, signs[table])[near], axis=1))
    needed = np.sort(met.ravel())
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1


def _fitted(k: int, tables: int, recall: float, seed: int):
    def fitted(key: tuple[pa.Scalar, ...], sample: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(sample.sort_by("vid").column("x").to_pylist()), "<f8").reshape(sample.num_rows, -1)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "depth": [depth_for(x, k, tables, recall, seed)]})

    return fitted


def _hasher(tables: int, asking: bool, seed: int):
    """Rows by table and axis: the nearest axis of each table, or the ``depth`` nearest of all that a query probes.

    Where a query would probe more axes than one table has, all of the first
    table's axes are probed and the others left out: that is exact, and cheaper.
    """

    def hashed(batches):
        for batch in batches:
            sizes, depths = batch.column("dim").to_numpy(), batch.column("depth").to_numpy()
            blobs = np.array(batch.column("x").to_pylist(), dtype=object)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                signs = rotations(int(dim), tables, seed)
                wide, depth = 2 * signs.shape[2], int(depths[rows[0]])
                if depth >= wide:
                    signs, depth = signs[:1], wide
                at_once = max(1, HELD // (wide * len(signs)))
                for start in range(0, len(rows), at_once):
                    some = rows[start : start + at_once]
                    units = unit(np.frombuffer(b"".join(blobs[some]), "<f8").reshape(len(some), dim))
                    if asking:
                        near = products(units, signs)
                        found = np.argpartition(-near, min(depth, near.shape[1] - 1), axis=1)[:, :depth]
                    else:
                        found = np.stack([i * wide + axis(units, s) for i, s in enumerate(signs)], axis=1)
                    at = np.repeat(some, found.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("vid").take(pa.array(at)),
                            pa.array(np.full(len(at), dim, np.int32)),
                            pa.array((found.ravel() // wide).astype(np.int32)),
                            pa.array((found.ravel() % wide).astype(np.int32)),
                            pa.array(blobs[at].tolist(), pa.binary()),
                        ],
                        names=["vid", "dim", "tab", "axis", "x"],
                    )

    return hashed


def _as_bytes(batches):
    for batch in batches:
        lists = batch.column("v")
        values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        raw = values.astype("<f8").tobytes()
        blobs = [raw[8 * a : 8 * b] for a, b in zip(offsets[:-1], offsets[1:])]
        columns = [batch.column("vid"), pa.array(np.diff(offsets).astype(np.int32)), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["vid", "dim", "x"])


def _nearest(k: int, rows_at_once: int = 256):
    """The k + 1 nearest of each query in one part of a bucket or size; ties to the smaller vid."""

    def searched(key: tuple[pa.Scalar, ...], queries: pa.Table, base: pa.Table) -> pa.Table:
        schema = pa.schema([("qvid", pa.int64()), ("cvid", pa.int64()), ("score", pa.float64())])
        if not queries.num_rows or not base.num_rows:
            return schema.empty_table()
        dim = key[0].as_py()
        q, x = (np.frombuffer(b"".join(t.column("x").to_pylist()), "<f8").reshape(-1, dim) for t in (queries, base))
        qvid, cvid = (t.column("vid").to_numpy() for t in (queries, base))
        norms, keep, out = (x * x).sum(axis=1), min(k + 1, len(x)), []
        for start in range(0, len(q), rows_at_once):
            part = q[start : start + rows_at_once]
            rough = norms - 2 * part @ x.T + (part * part).sum(axis=1, keepdims=True)
            # The rough square only selects, with room for its rounding; distances are taken anew.
            limit = np.partition(rough, keep - 1, axis=1)[:, keep - 1] + 1e-9 * (1 + norms.max() + (part * part).sum(axis=1))
            row, col = np.nonzero(~(rough > limit[:, None]))
            exact = np.sqrt(((part[row] - x[col]) ** 2).sum(axis=1))
            order = np.lexsort((cvid[col], exact, row))
            row, col, exact = row[order], col[order], exact[order]
            first = np.r_[True, row[1:] != row[:-1]]
            nth = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
            top = nth < keep
            out.append((qvid[start + row[top]], cvid[col[top]], exact[top]))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)

    return searched


def _completed(near: DataFrame, distinct: DataFrame, known: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """``near``, with the exact answers of queries that met too few vectors.

    These are compared with all vectors of their size, in parts of bounded size on both sides.
    """
    vectors = distinct.select("vid", F.size("v").alias("dim"), "v")
    asked = vectors.join(known.select(F.col("qvid").alias("vid")).distinct(), "vid")
    met = near.join(distinct.select(F.col("vid").alias("cvid"), F.size("ids").alias("n")), "cvid").groupBy("qvid").agg(F.sum("n").alias("met"))
    lacking = asked.join(met.withColumnRenamed("qvid", "vid"), "vid", "left").join(F.broadcast(sizes), "dim")
    lacking = lacking.filter(F.coalesce("met", F.lit(0)) < F.least(F.lit(k + 1), "ids"))
    lacking = stored(lacking.select("vid", "dim", "v", F.ceil(F.col("vectors") / BASE_ROWS).alias("base_parts")), "lacking")
    # One row a vector size.
    parts = F.broadcast(lacking.groupBy("dim", "base_parts").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("query_parts")))

    as_bytes = lambda df: df.select("vid", "v").mapInArrow(_as_bytes, "vid long, dim int, x binary")
    base = as_bytes(vectors.join(parts, "dim", "left_semi")).join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("vid"), "base_parts"))
    base = base.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_parts") - 1)))
    queries = as_bytes(lacking).join(parts, "dim").withColumn("block", F.pmod(F.xxhash64("vid"), "query_parts"))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("base_parts") - 1)))
    task = ["dim", "part", "block"]
    pairs = queries.select(*task, "vid", "x").groupBy(task).cogroup(base.select(*task, "vid", "x").groupBy(task))
    exact = pairs.applyInArrow(_nearest(k), "qvid long, cvid long, score double")
    return near.join(lacking.select(F.col("vid").alias("qvid")), "qvid", "left_anti").unionByName(exact)


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    tables: int = 12,
    recall: float = 0.95,
    seed: int = 7,
    vector_col: str = "embedding",
    id_col: str = "vec_id",
    probes: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): about the ``k`` nearest ``rows`` of each of ``queries``.

    Unit vectors are rotated at random ``tables`` times and hashed to their
    nearest signed axis. A query probes the axes nearest to it, ranked over all
    tables together: ``probes`` of them or, by default, as many as meet the share
    ``recall`` of the exact nearest in a sample of each vector size. That sample
    takes vectors by a hash of their ids, ``SAMPLE`` components or ``SAMPLE_ROWS``
    vectors if these are more; every vector is indexed. Where that many probes are
    no fewer than the axes of one table, as in small tables, the query probes all of one
    table, which is exact.

    What a query meets is ranked by the exact Euclidean distance between the
    original vectors, ties to the smaller id. Its own id is no answer. A query that
    meets too few is compared with all vectors of its size; no list is short while
    there are candidates.

    Rows with a NULL id take no part, nor do NULL, empty or zero vectors and such
    as hold NULL or non-finite components. Repeated rows count once. Vectors of
    another size than the query's are never its neighbours.

    Equal vectors are one entry. A bucket is cut into parts of bounded size on
    both sides, so a hot one becomes more tasks, not a longer one, and a task
    returns no more than the nearest of each query.
    """
    ok = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(
        F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    )
    distinct = stored(collapse(ok(rows).withColumn("v", F.col("v").cast("array<double>")), k), "vectors")
    asked = ok(queries).withColumn("v", F.col("v").cast("array<double>")).distinct()
    known = stored(asked.join(distinct.select("vid", "v"), "v").select("id", F.col("vid").alias("qvid")), "asked")

    # One row a vector size, so it may be sent to every executor.
    sizes = distinct.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("vectors"), F.sum(F.size("ids")).alias("ids"))
    as_bytes = lambda df: df.select("vid", "v").mapInArrow(_as_bytes, "vid long, dim int, x binary")
    if probes is None:
        share = F.ceil(F.col("vectors") / F.greatest(F.lit(SAMPLE) / F.col("dim"), F.lit(SAMPLE_ROWS)))
        some = distinct.join(F.broadcast(sizes.select("dim", share.alias("share"))), F.size("v") == F.col("dim"))
        sample = as_bytes(some.filter(F.pmod(F.xxhash64("vid"), "share") == 0))
        depths = sample.groupBy("dim").applyInArrow(_fitted(k, tables, recall, seed), "dim int, depth long")
        sizes = sizes.join(depths, "dim", "left").withColumn("depth", F.coalesce("depth", 2 * tables * F.col("dim").cast("long")))
    else:
        sizes = sizes.withColumn("depth", F.lit(probes).cast("long"))
    sizes = stored(sizes, "sizes")
    deep = lambda df: as_bytes(df).join(F.broadcast(sizes.select("dim", "depth")), "dim")

    schema = "vid long, dim int, tab int, axis int, x binary"
    base = deep(distinct).mapInArrow(_hasher(tables, False, seed), schema)
    probing = deep(distinct.join(known.select(F.col("qvid").alias("vid")).distinct(), "vid")).mapInArrow(_hasher(tables, True, seed), schema)
    bucket = ["dim", "tab", "axis"]
    # One row per table and axis, so its size doesn't grow with the rows.
    parts = base.groupBy(bucket).agg(F.ceil(F.count("*") / BASE_ROWS).alias("base_parts"))
    parts = parts.join(probing.groupBy(bucket).agg(F.ceil(F.count("*") / QUERY_ROWS).alias("query_parts")), bucket)
    parts = stored(parts, "buckets")
    base = base.join(parts, bucket).withColumn("part", F.pmod(F.xxhash64("vid"), "base_parts"))
    base = base.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_parts") - 1)))
    probing = probing.join(parts, bucket).withColumn("block", F.pmod(F.xxhash64("vid"), "query_parts"))
    probing = probing.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("base_parts") - 1)))
    task = [*bucket, "part", "block"]
    pairs = probing.select(*task, "vid", "x").groupBy(task).cogroup(base.select(*task, "vid", "x").groupBy(task))
    found = pairs.applyInArrow(_nearest(k), "qvid long, cvid long, score double")
    order = W.partitionBy("qvid").orderBy("score", "cvid")
    near = found.distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth")
    return ranked(_completed(stored(near, "near"), distinct, known, sizes, k), distinct, known, k, F.col("score"))
