"""What changed between two states of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import digests, halves, row_hash
from ..session import write_through


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    """(bucket, rows, digest_a, digest_b): what the rows of each hash bucket of ``key`` amount to."""
    return digests(df, [_bucket(key, buckets).alias("bucket")], sorted(df.columns))


def differing_buckets(before: DataFrame, after: DataFrame, key: Sequence[str], buckets: int) -> list[int]:
    """Buckets whose rows differ: those whose digest only one side has. Never more than ``buckets`` numbers."""
    both = bucket_digests(before, key, buckets).unionByName(bucket_digests(after, key, buckets))
    once = both.groupBy("bucket", "rows", "digest_a", "digest_b").agg(F.count("*").alias("sides")).filter("sides = 1")
    return sorted(r.bucket for r in once.select("bucket").distinct().collect())


#: Differing keys, as hashes of four bytes, that are sent to every task; more of them are joined by a shuffle.
SENT_KEYS = 4_000_000


def _key_hash(key: Sequence[str]) -> Column:
    # Four bytes: they are what is shuffled. Keys that share them are looked at together, which costs some equal rows more.
    # The NULL flags tell NULLs of several key columns apart.
    return F.hash(F.lit(2), *key, *[F.col(c).isNull() for c in key])


def differing_keys(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """(_key): hashes of the keys whose rows differ.

    Both sides are summed at once, the rows of ``after`` with a minus: where the
    rows are the same nothing is left. Only four small numbers a key and side are
    shuffled. A row counts by a hash of 64 bits, as a column does in ``snapshot_diff``.
    """

    def signed(df: DataFrame, sign: int) -> DataFrame:
        hashed = df.select(_key_hash(key).alias("_key"), row_hash(sorted(df.columns), 0).alias("_row"))
        high, low = halves("_row")
        return hashed.select("_key", F.lit(sign).cast("long").alias("_rows"), (high * sign).alias("_high"), (low * sign).alias("_low"))

    both = signed(before, 1).unionByName(signed(after, -1))
    left = both.groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("_rows", "_high", "_low")])
    return left.filter((F.col("_rows") != 0) | (F.col("_high") != 0) | (F.col("_low") != 0)).select("_key")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str | Sequence[str], buckets: int = 4096) -> DataFrame:
    """Keys that were added, removed or changed, with the columns that changed.

    Columns: the key, ``change``, ``changed_columns`` (comma-separated, in column
    order; NULL unless changed), ``rows_before`` and ``rows_after``. A key that
    occurs more than once is compared as the set of its rows, column by column;
    if their number changed ``rows`` is listed instead of columns. NULL is a key
    like others. Both sides need the same columns.

    Each side is first reduced to a digest per hash bucket of the key. Only rows
    of buckets that differ are looked at again, so two snapshots that differ
    little cost two scans. Where changes are spread over all buckets, a digest a
    key finds the keys that differ; column by column only their rows are shuffled
    and joined. ``buckets`` bounds what the driver sees; more of them leave fewer
    equal rows in a bucket that differs.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError(f"columns differ: {sorted(set(before.columns) ^ set(after.columns))}")
    columns = [c for c in before.columns if c not in keys]
    differing = differing_buckets(before, after, keys, buckets)

    def inside(df: DataFrame) -> DataFrame:
        return df.filter(_bucket(keys, buckets).isin(differing)) if differing else df.limit(0)

    before, after = inside(before), inside(after)
    if differing:
        found = write_through(differing_keys(before, after, keys), "differing")
        found = F.broadcast(found) if found.count() <= SENT_KEYS else found

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.join(found, _key_hash(keys) == F.col("_key"), "left_semi") if differing else df
        # NULL and a value are told apart by the flag; the sum doesn't depend on the order of equal keys.
        content = [F.sum(F.xxhash64(F.col(c).isNull(), c).cast("decimal(38,0)")).alias(f"{name}_{c}") for c in columns]
        named = rows.groupBy(*keys).agg(F.count("*").alias(f"rows_{name}"), *content)
        return named.withColumnsRenamed({c: f"{name}_key_{c}" for c in keys})

    was, now = side(before, "before"), side(after, "after")
    if not differing:
        none = was.select(*[F.col(f"before_key_{c}").alias(c) for c in keys])
        return none.select("*", *[F.lit(None).cast(t).alias(n) for n, t in _OUT.items()])
    same = reduce(Column.__and__, [F.col(f"before_key_{c}").eqNullSafe(F.col(f"after_key_{c}")) for c in keys])
    joined = was.join(now, same, "full")
    moved = [F.when(~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")), F.lit(c)) for c in columns]
    listed = F.when(F.col("rows_before") != F.col("rows_after"), "rows").otherwise(F.concat_ws(",", *moved))
    change = F.when(F.col("rows_before").isNull(), "added").when(F.col("rows_after").isNull(), "removed").when(listed != "", "changed")
    return joined.select(
        *[F.coalesce(f"before_key_{c}", f"after_key_{c}").alias(c) for c in keys],
        change.alias("change"),
        F.when(change == "changed", listed).alias("changed_columns"),
        F.coalesce("rows_before", F.lit(0)).alias("rows_before"),
        F.coalesce("rows_after", F.lit(0)).alias("rows_after"),
    ).filter(F.col("change").isNotNull())


_OUT = {"change": "string", "changed_columns": "string", "rows_before": "long", "rows_after": "long"}
