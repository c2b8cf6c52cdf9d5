"""Star schema: splitting the flat table, generated keys and integrity checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import calendar
from ..schemas import CREATIVE_COLUMNS, PERFORMANCE_COLUMNS, PRODUCT_COLUMNS, REVENUE_COLUMNS
from ..session import write_through


@dataclass(frozen=True)
class Star:
    """The five tables. ``creative`` is the parent; ``performance`` and ``revenue`` hold one row per ``row_id``."""

    creative: DataFrame
    performance: DataFrame
    revenue: DataFrame
    products: DataFrame
    dates: DataFrame

    def facts(self, *columns: str) -> DataFrame:
        """One wide row per campaign, joining only the tables that own a requested column.

        With no columns named, all five are joined. Leaving a child out is the
        same as joining it as long as ``fanout`` and ``orphans`` find nothing.
        Both children join on ``row_id``, so the parent is shuffled once; how the
        dimensions join is left to adaptive execution, which sees their sizes.
        """
        wanted = set(columns)
        df = self.creative

        def needed(table: DataFrame) -> bool:
            return not wanted or bool(wanted & set(table.columns) - set(df.columns))

        for child, generated in ((self.performance, "performance_id"), (self.revenue, "revenue_id")):
            if needed(child):
                df = df.join(child.drop(generated), "row_id")
        if needed(self.products):
            df = df.join(self.products, "product")
        if needed(self.dates):
            df = df.join(self.dates, "date")
        return df.select(*columns) if columns else df


def dim_date(spark: SparkSession, first: dt.date | str, last: dt.date | str) -> DataFrame:
    """One row per day from ``first`` to ``last``, both included."""
    span = spark.range(1).select(
        F.lit(str(first)).cast("date").alias("first_day"), F.lit(str(last)).cast("date").alias("last_day")
    )
    return dim_date_over(span)


def dim_date_over(span: DataFrame) -> DataFrame:
    """Calendar for a one-row frame with ``first_day`` and ``last_day``."""
    days = span.select(F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day"))).alias("date"))
    return days.select("date", *calendar("date"))


def products_dim(flat: DataFrame) -> DataFrame:
    """Distinct products; running it fails if the economics differ within a product."""
    figures = PRODUCT_COLUMNS[1:]
    grouped = flat.groupBy("product").agg(
        *[F.min(c).alias(c) for c in figures], *[F.max(c).alias(f"_{c}") for c in figures]
    )

    def settled(name: str):
        clash = F.concat(F.lit(f"{name} varies within product "), F.col("product"))
        return F.when(F.col(name) != F.col(f"_{name}"), F.raise_error(clash)).otherwise(F.col(name)).alias(name)

    return grouped.select("product", *[settled(c) for c in figures])


def part() -> Column:
    """Part of the sort in which a row of ``in_places`` lies."""
    return F.shiftright("_slot", 33)


def nth() -> Column:
    """Place of a row inside its part, from 0."""
    return F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))


def assign_ids(
    df: DataFrame, id_column: str, prefix: str, order_by: Sequence[str], width: int = 6, after: int = 0, laid: bool = False
) -> DataFrame:
    """Consecutive ids such as ``P000001`` in the order of ``order_by``.

    The rows are sorted across all tasks and written once with their place
    inside their partition; the size of each partition then gives where its
    numbers start. Rows equal in ``order_by`` are told apart by a hash of all
    their other columns, so a value shared by many rows is spread over several
    partitions. Numbers of more than ``width`` digits are written in full, and
    the first is the one that follows ``after``. The input is read twice, to
    sample the order and to write. The written rows stay in the shared folder,
    which the owner of the folder cleans. ``laid``: the rows lie in that order
    already, ties included, and are written where they lie.
    """
    placed = write_through(in_places(df, order_by, laid), "ids")
    sizes = placed.groupBy(part().alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the sort, so never more than the number of shuffle partitions.
    numbered = placed.withColumn("_part", part()).join(F.broadcast(starts), "_part")
    number = F.col("_start") + nth() + (after + 1)
    return numbered.select(F.format_string(f"{prefix}%0{width}d", number).alias(id_column), *df.columns)


def tie(columns: Sequence[str], order_by: Sequence[str]) -> Column:
    """What tells rows apart that are equal in ``order_by``: a hash of all other columns."""
    return F.xxhash64(*[c for c in columns if c not in order_by])


def in_places(df: DataFrame, order_by: Sequence[str], laid: bool = False, parts: int | None = None) -> DataFrame:
    """The rows in the order of ``order_by`` with their place, ``_slot``: ``part`` of the sort and ``nth`` row inside it.

    The places hold for the rows as they are written; another run may sort into other parts.
    ``parts``: how many the sort has, where adaptive execution would join them until a task spills.
    """
    by = [F.col(c) for c in order_by] + ([tie(df.columns, order_by)] if set(df.columns) - set(order_by) else [])
    if laid:
        ordered = df
    else:
        ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by) if parts else df.orderBy(*by)
    return ordered.withColumn("_slot", F.monotonically_increasing_id())


def with_performance_id(performance: DataFrame, laid: bool = False) -> DataFrame:
    return assign_ids(performance, "performance_id", "P", ["row_id"], laid=laid)


def with_revenue_id(revenue: DataFrame) -> DataFrame:
    return assign_ids(revenue, "revenue_id", "R", ["row_id"])


def normalise(
    flat: DataFrame, dates: DataFrame | None = None, with_ids: bool = True
) -> Star:
    """Split the flat table into the five tables.

    ``with_ids`` generates the child keys, which needs one sorted write per
    child; joins use ``row_id`` and work without them.
    """
    performance, revenue = flat.select(*PERFORMANCE_COLUMNS), flat.select(*REVENUE_COLUMNS)
    if with_ids:
        performance, revenue = with_performance_id(performance), with_revenue_id(revenue)
    if dates is None:
        dates = dim_date_over(flat.select(F.min("date").alias("first_day"), F.max("date").alias("last_day")))
    return Star(flat.select(*CREATIVE_COLUMNS), performance, revenue, products_dim(flat), dates)


# --- integrity -----------------------------------------------------------


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child key values without a parent, and how many rows carry each.

    Keys are counted before the join, so a value held by most rows costs no
    more than a rare one. NULL keys reference nothing and are not orphans.
    """
    used = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return used.join(known, key, "left_anti")


def orphan_counts(star: Star) -> DataFrame:
    """Orphans of every foreign key of the star."""
    checks = {
        "ad_creative.product": orphans(star.creative, star.products, "product"),
        "ad_creative.date": orphans(star.creative, star.dates, "date"),
        "ad_performance.row_id": orphans(star.performance, star.creative, "row_id"),
        "revenue.row_id": orphans(star.revenue, star.creative, "row_id"),
    }
    counted = [
        found.agg(
            F.lit(name).alias("foreign_key"),
            F.count("*").alias("orphan_keys"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"),
        )
        for name, found in checks.items()
    ]
    result = counted[0]
    for one in counted[1:]:
        result = result.unionByName(one)
    return result


def fanout(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count("*").alias("cnt")).filter(F.col("cnt") > 1)


def view_fanout(star: Star) -> DataFrame:
    """``row_id`` values that the master views repeat, without building the views.

    A joined ``row_id`` occurs as often as the product of its counts in the
    three tables, so only one counted row per id and table is joined.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("row_id").agg(F.count("*").alias(name))

    per_id = (
        counted(star.creative, "_parents")
        .join(counted(star.performance, "_performance"), "row_id")
        .join(counted(star.revenue, "_revenue"), "row_id")
    )
    times = F.col("_parents") * F.col("_performance") * F.col("_revenue")
    return per_id.select("row_id", times.alias("cnt")).filter(F.col("cnt") > 1)


def master_rows(star: Star) -> DataFrame:
    """Number of rows that a master view has, as ``row_count``, without building the view.

    A joined ``row_id`` counts as often as the product of its rows in the three
    tables, parents without their product or date left out. The dimensions have
    one row per key.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("row_id").agg(F.count("*").alias(name))

    parents = star.creative.join(star.products.select("product"), "product").join(star.dates.select("date"), "date")
    per_id = (
        counted(parents, "_parents")
        .join(counted(star.performance, "_performance"), "row_id")
        .join(counted(star.revenue, "_revenue"), "row_id")
    )
    times = F.col("_parents") * F.col("_performance") * F.col("_revenue")
    return per_id.agg(F.coalesce(F.sum(times), F.lit(0)).alias("row_count"))


#: Repeated keys, as hashes of eight bytes, that are sent to every task; with more of them all rows are collapsed.
SENT_KEYS = 4_000_000


def keep_first(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per ``key``: the one with the smallest ``by``.

    Hashes of the keys are counted first, and only rows whose hash occurs more
    than once are collapsed: a row that is alone with its key is not shuffled.
    ``df`` is read three times, the first time for its keys alone.
    """
    hashed = F.xxhash64(key)
    counted = df.select(hashed.alias("_key")).groupBy("_key").agg(F.count("*").alias("_rows"))
    repeated = write_through(counted.filter("_rows > 1").select("_key"), "repeated")
    if repeated.count() > SENT_KEYS:
        return collapse(df, key, by)
    met = F.broadcast(repeated)
    alone, several = (df.join(met, hashed == F.col("_key"), how) for how in ("left_anti", "left_semi"))
    return alone.unionByName(collapse(several, key, by))


def collapse(df: DataFrame, key: str, by: str, *beside: str) -> DataFrame:
    """What ``keep_first`` gives, by an aggregate over all rows; ``beside``: columns that follow from the key.

    A minimum over whole rows, combined before the shuffle, so a key with very
    many copies never gathers in one task.
    """
    rest = [c for c in df.columns if c not in (key, by, *beside)]
    missing_last = F.col(by).isNull().alias("_missing")
    first = df.groupBy(*beside, key).agg(F.min(F.struct(missing_last, by, *rest)).alias("_first"))
    return first.select(*beside, key, "_first.*").select(*df.columns)


def reconcile(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each named frame."""
    counts = [df.agg(F.lit(name).alias("source"), F.count("*").alias("row_count")) for name, df in frames.items()]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result
