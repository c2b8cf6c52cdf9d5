"""Ranked lexical search that scores documents with the same bag of terms once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import dropped, stored

#: Item terms taken in one pass over the documents, and items scored in one product.
PAIRS, TOGETHER = 2_000_000, 256
#: Numbers of a block of impacts, and the largest sum that doubles hold exactly.
BLOCK, EXACT = 4_000_000, 2**53
#: Bytes of a term, letters in lower case; all others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Stretches of ASCII letters and digits and all characters beyond ASCII, A-Z in lower case, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _item_blocks(items: DataFrame, item_col: str, text_col: str, pairs: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, so many at a time that they hold about ``pairs`` terms."""
    block, size = [], 0
    for item, text in items.select(item_col, text_col).toLocalIterator():
        block.append((item, sorted(set(terms_of(text)))))
        size += len(block[-1][1])
        if size >= pairs:
            yield block
            block, size = [], 0
    if block:
        yield block


def bags(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, bag) for each row: all its terms counted, and those of ``vocabulary`` with their counts.

    ``bag`` holds the places of the terms in ``vocabulary``, ascending, and then
    their counts, as little-endian unsigned 32-bit integers; empty if there are none.
    """
    place = {term: i for i, term in enumerate(vocabulary)}

    def bag(words: list[bytes]) -> bytes:
        known = [i for i in map(place.get, words) if i is not None]
        return np.concatenate(np.unique(np.array(known, "<u4"), return_counts=True)).astype("<u4").tobytes()

    def counted(batches):
        for batch in batches:
            words = map(terms_of, (t.as_py() for t in batch.column("text")))
            sizes, found = [], []
            for w in words:
                sizes.append(len(w))
                found.append(bag(w))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=["id", "n", "bag"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(counted, "id long, n long, bag binary")


def classes(rows: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(bag, m, size, ids) for each class of documents with equal bag and equal length figure ``m``.

    Rows meet by their hash, and the whole bag is compared. ``ids`` are the ``k``
    smallest of the class in order, NULLs last; no other can be among a query's
    ``k`` best. Both shuffles combine the rows of a class before they send it.
    """
    m = F.expr(f"100 - 90 + (90 * n * {n_docs}L) div {max(n_terms, 1)}L")
    some = rows.filter(F.octet_length("bag") > 0).select("id", "bag", m.alias("m"))
    sizes = some.groupBy("bag", "m").agg(F.count("*").alias("size"))
    order = Window.partitionBy("bag", "m").orderBy(F.col("id").asc_nulls_last())
    first = some.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    ids = first.groupBy("bag", "m").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("ids"))
    return sizes.join(ids, ["bag", "m"]).select("bag", "m", "size", F.col("ids.id").alias("ids"))


def _document_counts(grouped: DataFrame, n_vocabulary: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def counted(batches):
        held = np.zeros(n_vocabulary, np.int64)
        for batch in batches:
            for bag, size in zip(batch.column("bag"), batch.column("size").to_pylist()):
                ids = np.frombuffer(bag.as_buffer(), "<u4")
                held[ids[: len(ids) // 2]] += size
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "df"])

    parts = grouped.select("bag", "size").mapInArrow(counted, "term long, df long")
    df = np.zeros(n_vocabulary, np.int64)
    for row in parts.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row.term] = row.df
    return df


def _scorer(wanted: list[np.ndarray], weights: np.ndarray, k: int):
    """Walks classes; gives each item's ``k`` best of the task as (item, score, ids)."""
    groups = [(a, wanted[a : a + TOGETHER]) for a in range(0, len(wanted), TOGETHER)]
    # One class scores at most a millionth part of 10**12 a term: impacts stay under 1,000,000.
    most = int(weights.max(initial=0)) * 1_000_000 * max(map(len, wanted), default=0)
    kind = np.float64 if most < EXACT else np.int64

    def matrices():
        for start, items in groups:
            terms = np.unique(np.concatenate(items)) if items else np.empty(0, np.int64)
            matrix = np.zeros((len(terms), len(items)), kind)
            for j, own in enumerate(items):
                matrix[np.searchsorted(terms, own), j] = weights[own]
            yield start, terms, matrix

    def scored(batches):
        ready = list(matrices()) if len(groups) == 1 else None
        best: list[list[tuple[int, int, int, list]]] = [[] for _ in wanted]
        floor = np.zeros(len(wanted), np.int64)
        for batch in batches:
            bag = [np.frombuffer(b.as_buffer(), "<u4").astype(np.int64) for b in batch.column("bag")]
            m, ids = batch.column("m").to_numpy(), batch.column("ids").to_pylist()
            for start, terms, matrix in ready or matrices():
                step = max(1, BLOCK // max(1, len(terms)))
                for a in range(0, len(bag), step):
                    part = bag[a : a + step]
                    half = np.array([len(b) // 2 for b in part])
                    row = np.repeat(np.arange(len(part)), half)
                    term = np.concatenate([b[: len(b) // 2] for b in part])
                    tf = np.concatenate([b[len(b) // 2 :] for b in part])
                    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[a : a + step][row])
                    at = np.searchsorted(terms, term)
                    known = (at < len(terms)) & (terms[np.minimum(at, max(len(terms) - 1, 0))] == term) if len(terms) else np.zeros(len(term), bool)
                    dense = np.zeros((len(part), len(terms)), kind)
                    dense[row[known], at[known]] = impact[known]
                    points = (dense @ matrix).astype(np.int64)
                    for j in np.flatnonzero((points >= np.maximum(floor[start : start + matrix.shape[1]], 1)).any(axis=0)).tolist():
                        item, column = start + j, points[:, j]
                        good = np.flatnonzero(column >= max(1, floor[item]))
                        if len(good) > k:  # those above or equal to the k-th of this block
                            good = good[column[good] >= -np.partition(-column[good], k - 1)[k - 1]]
                        held = best[item]
                        for i in good.tolist():
                            lead = ids[a + i][0]
                            held.append((-int(column[i]), lead is None, lead or 0, ids[a + i]))
                        held.sort(key=lambda x: x[:3])
                        del held[k:]
                        if len(held) == k:
                            floor[item] = -held[-1][0]
        rows = [(item, -x[0], x[3]) for item, held in enumerate(best) for x in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))],
            names=["item", "score", "ids"],
        )

    return scored


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    pairs: int = PAIRS,
) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each item with a score above 0.

    A term of ``df`` of the ``N`` documents with terms weighs
    ``floor(1000 * ln((2N + 2) / (2df + 1)))``. A document of ``n`` terms, ``L``
    in all documents, has ``m = 10 + 90nN div L`` and scores, for each term of
    the item once, the weight times ``10**9 tf div (1000 tf + 8 m)``. Equal
    scores go by ascending id, NULL ids last. Ids are long.

    NULL and empty texts have no terms: as documents they count nowhere, as
    items they find nothing. Each row is a document or an item of its own, so
    repeated documents take a rank each, and repeated items a list each.

    Documents are cut down to the items' terms. Those of equal term counts and
    equal ``m`` form a class, which is scored once; its members come back in the
    order of their ids. So copies cost no more than one, however many they are.
    Items are taken in blocks of about ``pairs`` terms, and each block passes over all documents.
    """
    kind = items.schema[item_col].dataType.simpleString()
    spark, result = docs.sparkSession, None
    for block in _item_blocks(items, item_col, item_text, pairs):
        vocabulary = sorted(set().union(*(terms for _, terms in block)))
        place = {term: i for i, term in enumerate(vocabulary)}
        wanted = [np.array([place[t] for t in terms], np.int64) for _, terms in block]
        rows = stored(bags(docs, vocabulary, id_col, text_col), "bags")
        n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        grouped = stored(classes(rows, n_docs, n_terms, k), "classes")
        df = _document_counts(grouped, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found = grouped.select("bag", "m", "ids").mapInArrow(_scorer(wanted, weights, k), "item long, score long, ids array<long>")
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item long, name {kind}")
        listed = stored(_expanded(found, k).join(names, "item").select(F.col("name").alias("item"), "rank", "id", "score"), "ranked")
        dropped(rows)
        dropped(grouped)
        result = listed if result is None else result.unionByName(listed)
    return spark.createDataFrame([], f"item {kind}, rank int, id long, score long") if result is None else result


def _expanded(found: DataFrame, k: int) -> DataFrame:
    """(item, rank, id, score) from each task's best classes: the best over all tasks, members put in."""
    lead = F.col("ids")[0].asc_nulls_last()
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), lead)
    kept = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)
    members = kept.select("item", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return members.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
