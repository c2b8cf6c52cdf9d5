"""Document fingerprints: SimHash over weighted terms, and a search by permuted block tables.

Everything here is DataFrame functions.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import ascii_lower, stored, wide_hash

BITS, HALF = 64, 32
#: Tasks that the fingerprints of one block value are dealt to when they meet the queries.
SALTS = 8


def voted(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp): the fingerprint, a signed long, of ``text`` for each distinct ``keys``.

    Terms are the words between ASCII white space with A-Z in lower case. A
    term that occurs tf times weighs ``1 + ln(tf)``, to eighths. Its 64-bit
    hash votes with that weight for each bit that it sets and against each other
    one; a bit is set where the votes for it prevail. Texts without a word give 0.

    Bits j and j + 32 are summed as the two halves of one long, which fills 32
    registers instead of 64. A half can't overflow: a text of two gigabytes, the
    most that a string holds, has under 2**29 distinct words, of weight 8 each.
    """
    words = F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+")
    # Terms are known by their hashes, so that only numbers are grouped; '' has none.
    hashes = texts.select(*keys, F.explode(words).alias("term")).select(*keys, F.when(F.col("term") != "", F.xxhash64("term")).alias("h"))
    counted = hashes.groupBy(*keys, "h").agg(F.count("*").alias("tf"))
    weight = F.when(F.col("h").isNull(), 0).otherwise(F.round(8 + 8 * F.log("tf"))).cast("long")
    terms = counted.select(*keys, F.coalesce("h", F.lit(0)).alias("h"), weight.alias("w"))
    pair = F.lit(1 | 1 << HALF)
    sums = [F.sum(F.col("w") * F.shiftrightunsigned("h", j).bitwiseAND(pair)).alias(f"v{j}") for j in range(HALF)]
    votes = terms.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)

    def bit(votes_for: Column, at: int) -> Column:
        return F.when(2 * votes_for > F.col("total"), F.lit(_signed(1 << at))).otherwise(F.lit(0).cast("long"))

    low = [bit(F.col(f"v{j}").bitwiseAND(F.lit((1 << HALF) - 1)), j) for j in range(HALF)]
    high = [bit(F.shiftrightunsigned(f"v{j}", HALF), j + HALF) for j in range(HALF)]
    return votes.select(*keys, reduce(Column.bitwiseOR, low + high).alias("fp"))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def following(rows: DataFrame) -> DataFrame:
    """``rows`` (id, r1, r2, ...) with ``n1``, ``n2``: the hashes of the row that follows by descending id.

    NULL ids come last, equal ids by their hashes, and the last row is followed
    by the first. The rows are sorted across all tasks and written once; the
    number of rows in each part gives every row its place, and a row meets the
    one that holds the next place.
    """
    ordered = rows.orderBy(F.col("id").desc_nulls_last(), "r1", "r2")
    placed = stored(ordered.withColumn("slot", F.monotonically_increasing_id()), "order")
    part = F.shiftright("slot", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    # One row per partition of the sort, so never more than the number of shuffle partitions.
    place = F.col("start") + F.col("slot").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", place).drop("part", "slot", "start")
    total = placed.agg(F.count("*").alias("total")).first().total
    last = F.lit(max(total - 1, 0)).cast("long")
    wanted = F.when(F.col("place") == 0, last).otherwise(F.col("place") - 1)
    return ranked.join(ranked.select(wanted.alias("place"), F.col("r1").alias("n1"), F.col("r2").alias("n2")), "place").drop("place")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) for each row of ``docs``.

    The edited text has the last third of the code points (rounded down)
    replaced by the first as many, or all, of the document that follows by
    descending id; the last one is followed by the first. ``near_edited`` and
    ``near_next`` are the share of equal bits with the edited text's and the
    following document's fingerprint.

    NULL and empty texts are '' with fingerprint 0, and edited they stay ''. A
    single document follows itself. Rows that repeat id and text are one
    document, and each of them gets its result; rows that share only an id, and
    rows without one, are documents of their own, in the order of a hash.

    Whole texts move once, by a hash of id and text, so no id and no source
    makes a task larger, and copies of a row are combined before. The
    following document's part of an edited text moves once more. Terms are
    counted and votes summed where the text lies.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(F.col(id_col).alias("id"), *(h.alias(n) for h, n in zip(wide_hash(F.col(id_col), text), ("r1", "r2"))), text.alias("text"))
    whole = every.groupBy("r1", "r2").agg(F.first("text").alias("text"))
    third = F.expr("int(length(text) div 3)")
    narrow = every.select("id", "r1", "r2", third.alias("k")).distinct()
    chain = stored(following(narrow), "chain")
    asked = chain.select("n1", "n2", F.col("r1").alias("a1"), F.col("r2").alias("a2"), "k")
    parts = whole.withColumnsRenamed({"r1": "n1", "r2": "n2"}).join(asked, ["n1", "n2"])
    parts = parts.select(F.col("a1").alias("r1"), F.col("a2").alias("r2"), F.substring("text", F.lit(1), "k").alias("part"))
    kept = F.substring("text", F.lit(1), F.length("text") - third)
    both = whole.join(parts, ["r1", "r2"]).select("r1", "r2", "text", F.concat(kept, "part").alias("edited"))
    facts = both.select("r1", "r2", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    # Apart, as one long chain of generators and aggregates would be a method too large for the JVM to compile.
    own = voted(whole, ["r1", "r2"])
    of_edited = voted(both.select("r1", "r2", F.col("edited").alias("text")), ["r1", "r2"]).withColumnRenamed("fp", "edited_fp")
    known = stored(facts.join(own, ["r1", "r2"]).join(of_edited, ["r1", "r2"]), "fingerprints")
    nexts = known.select(F.col("r1").alias("n1"), F.col("r2").alias("n2"), F.col("fp").alias("next_fp"))
    result = known.join(chain.select("r1", "r2", "n1", "n2"), ["r1", "r2"]).join(nexts, ["n1", "n2"])
    result = result.select(
        "r1", "r2", "n_chars", "edited_sha256", "fp", "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
    return every.select("id", "r1", "r2").join(result, ["r1", "r2"]).drop("r1", "r2")


def block_masks(radius: int) -> list[int]:
    """Bits (unsigned) of each block table.

    A fingerprint is cut into ``radius + 3`` blocks. Two that differ in at most
    ``radius`` bits agree in three whole blocks at least, so there is a table for
    each choice of three, whose key are their bits moved together to the front:
    the same as the fingerprint with all other bits cleared.
    """
    n = radius + 3
    if not 0 <= radius <= BITS - 3:
        raise ValueError(f"radius has to be 0 to {BITS - 3}")
    cuts = [BITS * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    return [sum(three) for three in itertools.combinations(blocks, 3)]


def within(prints: DataFrame, queries: DataFrame, radius: int = 3, salts: int = SALTS) -> DataFrame:
    """(query, fp, bits): all pairs of a distinct ``query`` and a distinct ``fp`` within ``radius`` bits.

    ``prints`` (fp) and ``queries`` (query) are signed longs; NULLs match
    nothing. A pair that agrees in several tables is given by the first of them.
    The fingerprints of one block value are dealt to ``salts`` tasks, each of
    which meets all queries of that value.
    """
    masks = [_signed(m) for m in block_masks(radius)]

    def tables(value: str) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.col(value).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))

    filed = prints.select("fp").distinct().filter("fp is not null")
    filed = filed.select("fp", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int").alias("salt"), tables("fp"))
    asked = queries.select("query").distinct().filter("query is not null")
    asked = asked.select("query", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), tables("query"))
    differing = F.col("fp").bitwiseXOR(F.col("query"))
    first = F.coalesce(*[F.when(differing.bitwiseAND(F.lit(m)) == 0, t) for t, m in enumerate(masks)])
    # The tables multiply the queries after Spark has seen their size, so it must not broadcast them.
    met = filed.join(asked.hint("merge"), ["t", "key", "salt"])
    return met.select("query", "fp", "t", first.alias("first"), F.bit_count(differing).alias("bits")).filter(
        (F.col("bits") <= radius) & (F.col("t") == F.col("first"))
    ).select("query", "fp", "bits")


def with_near_counts(prints: DataFrame, is_query: Column, radius: int = 3) -> DataFrame:
    """``prints`` (fp, ...) with ``n_near``: for rows where ``is_query`` holds, how many other rows are within ``radius`` bits.

    NULL for the rows that do not ask. Equal fingerprints are searched once and
    counted as often as they occur.
    """
    asks = F.coalesce(is_query, F.lit(False))
    copies = prints.groupBy("fp").agg(F.count("*").alias("copies"))
    found = within(copies, prints.filter(asks).select(F.col("fp").alias("query")), radius)
    near = found.join(copies, "fp").groupBy(F.col("query").alias("fp")).agg((F.sum("copies") - 1).alias("n_near"))
    answered = prints.filter(asks).join(near, "fp", "left").select(*prints.columns, "n_near")
    return answered.unionByName(prints.filter(~asks).withColumn("n_near", F.lit(None).cast("long")))
