"""Language-model scores by stupid backoff, as joins with n-gram count tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spendlens.llm.common import SPACES, ascii_lower

#: Logarithms are summed as whole millionths, so a sum doesn't depend on its order.
MICRO = 1_000_000
#: Characters of a block of documents; a bucket of the count tables serves as many.
BLOCK_CHARS = 8_000_000
#: Stands for the start mark; words have hashes whose last bit is 0, longer n-grams 1.
START = np.uint64(0)
_WORD, _ONE = np.uint64(2**64 - 2), np.uint64(1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lowered, parted by ASCII white space."""
    plain = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _micro(x: np.ndarray | float) -> np.ndarray:
    return np.floor(np.log(x) * MICRO + 0.5).astype(np.int64)


def _collapsed(batches):
    """Equal rows of a batch as one with their number, so that no block is filled by copies of one row; texts packed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        seen: dict[tuple, int] = {}
        first = []
        for at, row in enumerate(zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())):
            if row not in seen:
                first.append(at)
            seen[row] = seen.get(row, 0) + 1
        out = batch.select(["id", "block"]).take(pa.array(first, pa.int64()))
        packed = [t if t is None else pack(t) for _, t in seen]
        yield pa.RecordBatch.from_arrays(
            [*out.columns, pa.array(packed, pa.binary()), pa.array(seen.values(), pa.int64())], names=["id", "block", "packed", "copies"]
        )


def _grams(contexts: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that lengthen each context by a word."""
    x = ((contexts + np.uint64(n - 2)) ^ (contexts >> np.uint64(29))) * _MIX[0] + words
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return (x ^ (x >> np.uint64(31))) | _ONE


class _Block:
    """The distinct documents of a block and the n-grams in them, up to ``order`` words long."""

    def __init__(self, table: pa.Table, order: int):
        copies: dict[tuple, int] = {}
        for row in zip(*(table.column(c).to_pylist() for c in ("id", "packed", "copies"))):
            copies[row[:2]] = copies.get(row[:2], 0) + row[2]
        self.ids = [i for i, _ in copies]
        # Lower and split of bytes know ASCII only.
        unpack = zstandard.ZstdDecompressor().decompress
        parted = ((unpack(t) if t else b"").lower().split() for _, t in copies)
        words = [np.fromiter(map(xxhash.xxh64_intdigest, p), np.uint64) & _WORD for p in parted]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.n = int(self.lengths.sum())
        self.first = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        after = np.concatenate([*words, np.empty(0, np.uint64)])
        grams = [after]
        for n in range(2, order + 1):
            grams.append(_grams(self.before(grams[-1], START), after, n))
        self.weights = np.repeat(np.array(list(copies.values()), np.int64), self.lengths)
        starts = self.weights[self.first].sum()
        self.keys, at = np.unique(np.concatenate([[START], *grams]), return_inverse=True)
        self.counts = np.bincount(at, np.r_[starts, np.tile(self.weights, order)]).astype(np.int64)
        #: Places in ``keys`` of the n-grams that end at each word, by n; the start mark's is 0.
        self.at = [at[1 + i * self.n : 1 + (i + 1) * self.n] for i in range(order)]

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """The values at the word before each word, ``start`` at the first word of a document."""
        out = np.r_[start, values[:-1]][: self.n].astype(values.dtype)
        out[self.first] = start
        return out


def _edges(buckets: int) -> np.ndarray:
    """First hash of every bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def _counting(buckets: int, order: int):
    def counted(key, table):
        block = _Block(table, order)
        ends = np.r_[0, np.searchsorted(block.keys, _edges(buckets)), len(block.keys)]
        held = np.flatnonzero(np.diff(ends))
        return pa.table(
            {
                "block": pa.array(np.full(len(held), key[0].as_py(), np.int64)),
                "bucket": pa.array(held.astype(np.int64)),
                "keys": pa.array([block.keys[ends[b] : ends[b + 1]].view(np.int64) for b in held], pa.list_(pa.int64())),
                "counts": pa.array([block.counts[ends[b] : ends[b + 1]] for b in held], pa.list_(pa.int64())),
            }
        )

    return counted


def _totalled(table: pa.Table) -> pa.Table:
    keys, counts = table.column("keys").combine_chunks(), table.column("counts").combine_chunks()
    _, at = np.unique(keys.flatten().to_numpy().view(np.uint64), return_inverse=True)
    totals = np.bincount(at, counts.flatten().to_numpy()).astype(np.int64)[at]
    ends = np.r_[0, np.cumsum(keys.value_lengths().to_numpy())]
    back = pa.array([totals[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.list_(pa.int64()))
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "totals": back})


def _scoring(kind: pa.DataType, total: int, order: int, backoff: float, min_count: int):
    def scored(docs, answers):
        block = _Block(docs, order)
        rows = answers.sort_by("bucket").column("totals").combine_chunks()
        totals = rows.flatten().to_numpy()
        log = _micro(np.maximum(totals, 1))
        value = log[block.at[0]] - _micro(max(total, 1))
        place = np.arange(block.n) - np.repeat(block.first, block.lengths[block.lengths > 0])
        for shorter, (short, long) in enumerate(zip(block.at, block.at[1:])):
            told = np.where(totals[long] >= min_count, log[long] - log[block.before(short, 0)], value + _micro(backoff))
            # Contexts reach back to the start mark, no further.
            value = np.where(place >= shorter, told, value)
        value = np.r_[0, np.cumsum(value)]
        ends = np.r_[0, np.cumsum(block.lengths)]
        return pa.table(
            {"id": pa.array(block.ids, kind), "n_words": pa.array(block.lengths), "log_micro": pa.array(value[ends[1:]] - value[ends[:-1]])}
        )

    return scored


def backoff_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    backoff: float = 0.4,
    min_count: int = 2,
    block_chars: int = BLOCK_CHARS,
    order: int = 2,
) -> DataFrame:
    """(doc_id, n_words, log_micro, score) for each distinct (id, text) of ``docs``.

    A model of the n-grams of all documents up to ``order`` words, with a start
    mark before each document. A word's probability is count(n-gram) /
    count(its context) for the longest n-gram ending at it, where that occurs
    ``min_count`` times or more in the corpus, else ``backoff`` times what the
    context shorter by a word gives; without context it is count(word) /
    count(all words). At the start of a document the context is the mark and
    the words since it. ``log_micro`` sums the natural logarithms in
    millionths; ``score`` is their mean a word, NULL for a text without words.
    NULL and empty texts have no words. Repeated rows count in the corpus each,
    and are returned once.

    Documents are dealt by hash into blocks of about ``block_chars`` characters.
    A block explodes them and counts its n-grams, once each, so a hot one moves
    once a block. The count tables are parted by hash into buckets, as many as
    blocks, that add the blocks' counts up. Joined back to the blocks, the
    totals stand in the order of a block's hashes and need no key. Blocks and
    buckets hold a bounded number of n-grams, save where one document has more;
    each order above the first adds as many again. N-grams stand as 63-bit hashes.
    """
    if order < 1:
        raise ValueError("order has to be 1 or more")
    size = docs.select(F.sum(F.length(text_col)).alias("chars"), F.sum(F.size(words_of(F.col(text_col)))).alias("words")).first()
    total, blocks = size["words"] or 0, 1 + (size["chars"] or 0) // block_chars
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = keyed.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id", "text"), F.lit(blocks)))
    kind = docs.schema[id_col].dataType
    placed = dealt.mapInArrow(_collapsed, f"id {kind.simpleString()}, block long, packed binary, copies long")

    tables = placed.groupBy("block").applyInArrow(_counting(blocks, order), "block long, bucket long, keys array<long>, counts array<long>")
    totals = tables.groupBy("bucket").applyInArrow(_totalled, "block long, bucket long, totals array<long>")
    scores = (
        placed.groupBy("block")
        .cogroup(totals.groupBy("block"))
        .applyInArrow(_scoring(to_arrow_type(kind), total, order, backoff, min_count), f"id {kind.simpleString()}, n_words long, log_micro long")
    )
    score = F.when(F.col("n_words") > 0, F.col("log_micro") / F.col("n_words") / MICRO)
    return scores.select(F.col("id").alias(id_col), "n_words", "log_micro", score.alias("score"))
