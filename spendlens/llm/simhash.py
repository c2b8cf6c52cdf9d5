"""SimHash near-dedup through an inverted index of positional fingerprint bytes."""

from __future__ import annotations

import itertools
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import LOWER, UPPER, dealt_join, stored, wide_hash
from spendlens.llm.components import components

#: A fingerprint has this many bytes; their places are the index positions.
BYTES = 8
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if over half the shingle hashes set it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    wide = min(shingle, len(words))
    spans = map(slice, (ends - sizes)[: len(words) - wide + 1].tolist(), ends[wide - 1 :].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, r1, r2, fp): the row's id, a hash of id and text, its fingerprint as signed long."""
    narrow = docs.select(
        F.col(id_col).alias("id"),
        *(h.alias(n) for h, n in zip(wide_hash(F.col(id_col), F.col(text_col)), ("r1", "r2"))),
        F.col(text_col).alias("text"),
    )

    def hashed(batches):
        for batch in batches:
            texts = batch.column("text")
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            columns = [batch.column(n) for n in ("id", "r1", "r2")] + [pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "r1", "r2", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(hashed, f"id {kind}, r1 long, r2 long, fp long")


def index_groups(width: int, max_bits: int) -> list[tuple[int, ...]]:
    """Groups of ``width`` positions, one of which any guaranteed match contains whole.

    Fingerprints that differ in ``max_bits`` bits agree in at least
    ``BYTES - max_bits`` bytes. For four agreeing bytes of eight and width three,
    Turán's construction covers every choice of four places with twenty groups:
    the places fall into three classes, and a group lies in one class or has two
    places of a class and one of the next. Other settings take every group.
    """
    matches = BYTES - max_bits
    if not 1 <= width <= matches:
        raise ValueError(f"{max_bits} differing bits guarantee {matches} equal bytes; no group of {width}")
    groups = itertools.combinations(range(BYTES), width)
    if (matches, width) != (4, 3):
        return list(groups)
    kind = [0, 0, 0, 1, 1, 1, 2, 2]

    def held(group):
        a, b, c = (kind[i] for i in group)
        pair, single = (a, c) if a == b else (b, a) if b == c else (None, None)
        return a == b == c or pair is not None and single == (pair + 1) % 3 or a == c != b and b == (a + 1) % 3

    return [g for g in groups if held(g)]


def _spanning(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (signed) that connect what is linked inside one posting list, at most one a print.

    Shared positional bytes are tallied for each pair; pairs that reach the
    guaranteed number of equal bytes are verified bit by bit.
    """
    edges, left = [], prints
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            differing = left ^ at
            tally = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            near = tally >= BYTES - max_bits
            near[near] = np.bitwise_count(differing[near]) <= max_bits
            front.extend(left[near])
            edges.extend(zip(repeat(at.view(np.int64).item()), left[near].view(np.int64).tolist()))
            left = left[~near]
    return edges


def _links_in_lists(max_bits: int, cap: int):
    """Walks sorted posting lists; short ones give edges, long ones their prints.

    Rows out are (a, b): an edge, or a print paired with NULL where its list has
    over ``cap`` prints and has to be linked the other way.
    """

    def out(pairs, long):
        a, b = [p[0] for p in pairs] + long, [p[1] for p in pairs] + [None] * len(long)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def walked(batches):
        held_key, held, over = None, np.empty(0, np.uint64), False
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            pairs, long = [], []
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            # Lists of one print that begin and end inside the batch link nothing.
            inner = (ends - starts > 1) | (starts == 0) | (ends == len(keys))
            for s, e in zip(starts[inner].tolist(), ends[inner].tolist()):
                part = prints[s:e]
                if keys[s] == held_key:
                    held = np.concatenate([held, part])
                else:
                    if not over:
                        pairs += _spanning(held, max_bits)
                    held_key, held, over = keys[s], part.copy(), False
                if over or len(held) > cap:
                    over = True
                    long += held.view(np.int64).tolist()
                    held = held[:0]
            yield out(pairs, long)
        if not over:
            yield out(_spanning(held, max_bits), [])

    return walked


def _links_by_midpoint(prints: DataFrame, max_bits: int) -> DataFrame:
    """Edges among prints of overlong lists, linear in their number.

    Two prints differ in at most ``max_bits`` (even) bits if and only if some
    point lies within half as many bits of both. So prints that reach the same
    point are linked, and whatever is linked shares a point.
    """
    masks = [sum(1 << b for b in flips) for n in range(max_bits // 2 + 1) for flips in itertools.combinations(range(64), n)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    points = prints.select("fp", F.explode(F.lit(masks)).alias("mask"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return points.join(hubs, "point").filter("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def near_links(prints: DataFrame, max_bits: int = 4, width: int = 3, cap: int = 4096) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct ``fp`` within ``max_bits`` bits.

    Connected, not listed: a posting list gives at most one edge a print, never
    all its pairs. Lists over ``cap`` prints are linked through shared midpoints.
    """
    if max_bits % 2:
        raise ValueError("max_bits has to be even")
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]
    keys = []
    for n, group in enumerate(index_groups(width, max_bits)):
        key = F.lit(n).cast("long")
        for i in group:
            key = F.shiftleft(key, 8).bitwiseOR(byte[i])
        keys.append(key)
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = postings.repartition("key").sortWithinPartitions("key", "fp")
    found = stored(lists.mapInArrow(_links_in_lists(max_bits, cap), "a long, b long"), "links")
    links = found.filter("b is not null")
    long = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if long.isEmpty():
        return links
    return links.unionByName(_links_by_midpoint(long, max_bits))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    width: int = 3,
    cap: int = 4096,
) -> DataFrame:
    """(id, r1, r2, fp, root, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id that fingerprints within ``max_bits``
    bits of one another reach, the row's own included; ``root`` names the
    component by a fingerprint. NULL and empty texts have fingerprint zero and
    link like any other; fewer words than ``shingle`` make one shingle. Rows may
    repeat. Rows with a NULL id take part in linking; ``component_id`` is NULL
    where all ids of a component are.

    Equal fingerprints are collapsed before the search, so a large group of
    copies is one entry of the index; the fingerprints of a large component are
    dealt to several tasks where they learn its smallest id.
    """
    rows = stored(with_fingerprints(docs, id_col, text_col, shingle), "prints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(near_links(prints.select("fp"), max_bits, width, cap)).select(F.col("node").alias("fp"), "root")
    rooted = prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = dealt_join(rooted, best, "root", "fp").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("id", "r1", "r2", "fp", "root", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs``, of each near-duplicate group only that with the smallest id.

    Among rows of that id a hash of the text decides, and repeats of the row
    collapse. A group without any id keeps one row as well.
    """
    groups = near_groups(docs, id_col, text_col, **params)
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "r1", "r2")).alias("one")
    chosen = groups.groupBy("root").agg(first).select("one.r1", "one.r2")
    rows = docs.select(
        F.struct("*").alias("row"),
        *(h.alias(n) for h, n in zip(wide_hash(F.col(id_col), F.col(text_col)), ("r1", "r2"))),
    )
    return rows.join(chosen, ["r1", "r2"]).dropDuplicates(["r1", "r2"]).select("row.*")
