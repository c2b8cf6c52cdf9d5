"""Line dedup: drop lines that many documents share, all but one document's copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import SPACES, ascii_lower, wide_hash

#: Tasks that the rows of one line are dealt to when they meet what is known of the line.
SALTS = 8


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long_keys(text: Column, min_chars: int) -> Column:
    """(position, hashes) of each line whose key has ``min_chars`` code points."""
    keys = F.transform(_lines(ascii_lower(text)), lambda line: F.btrim(line, F.lit(SPACES)))
    placed = F.transform(keys, lambda key, i: F.struct(i.alias("pos"), key.alias("key")))
    long = F.filter(placed, lambda x: F.length(x["key"]) >= min_chars)
    return F.transform(
        long, lambda x: F.struct(x["pos"].alias("pos"), *(h.alias(n) for h, n in zip(wide_hash(x["key"]), ("h1", "h2"))))
    )


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, except in the largest id.

    A line's key is the line without ASCII white space at its ends and with A-Z
    in lower case; keys under ``min_chars`` code points are left alone. Returns
    struct ``row`` (the columns of ``docs``, the text replaced) and the counts
    ``n_lines`` (before dropping) and ``n_dropped``.

    NULL and empty texts are one empty line, so the text becomes ''. Rows that
    repeat an id count as one document and keep or lose a line together. Rows
    with a NULL id are no document: they don't count, and lose shared lines.

    Only hashes and positions move; whole texts move once, for the join that
    brings each document its dropped positions. A hot line is combined before
    its shuffle. In the join each line's rows are dealt to ``SALTS`` tasks by
    their document's hash; as both sides are shuffled for it, adaptive execution
    can split those further.
    """
    ident = F.col(f"__row.`{id_col}`")
    text = F.col(f"__row.`{text_col}`")
    rows = docs.select(F.struct("*").alias("__row"))
    keyed = rows.select("__row", *(h.alias(n) for h, n in zip(wide_hash(ident, text), ("r1", "r2"))))
    found = keyed.select(ident.alias("id"), "r1", "r2", F.inline(_long_keys(text, min_chars)))
    shared = (
        found.filter(F.col("id").isNotNull())
        .groupBy("h1", "h2")
        .agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    dropped = (
        found.withColumn("salt", F.pmod("r1", F.lit(SALTS)).cast("int"))
        .join(shared, ["h1", "h2", "salt"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("r1", "r2")
        .agg(F.collect_set("pos").alias("gone"))
    )
    lines = _lines(text)
    n_lines = F.size(lines)
    # Differences and lookups by position stay linear in the lines of a document.
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    new_text = F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept)
    return keyed.join(dropped, ["r1", "r2"], "left").select(
        F.struct(*(new_text.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns)).alias("row"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
