"""Whitening, document fingerprints and ranked search against slow forms."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hand import SF
from spendlens.llm import fingerprints, lexical, queries, whitening

# --- whitening -----------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n long, x string, size int, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "c") for i, v in rows], VECTORS)


def slow_whitening(rows, components=4):
    """Rows (id, component) -> figures, from the eigenvectors of the covariance matrix."""
    x = {}
    for i, v in rows:
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v):
            x.setdefault(i, []).append(tuple(math.floor(256 * float(np.float32(c))) for c in v))
    fit = sorted({v for vs in x.values() for v in vs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(v, sums)] for v in fit])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    out = {}
    for i, vs in x.items():
        for v in vs:
            for k, j in enumerate(order[:components]):
                if values[j] > 1e-12 * values[order[0]]:
                    white = (np.array(v) - np.array(sums) / n) @ directions[:, j] / math.sqrt(values[j])
                    out[i, k + 1] = (n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), white, values[j] / values.sum())
    return out


def same_whitening(found, rows):
    slow, signs = slow_whitening(rows), {}
    assert {(r.id, r.component) for r in found} == set(slow)
    for r in found:
        n, deviation, white, explained = slow[r.id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-6) and r.identity_error < 1e-9
        if abs(white) > 1e-6:
            signs.setdefault(r.component, set()).add(round(r.whitened / white, 4))
        else:
            assert abs(r.whitened) < 1e-5
    assert all(s in ({1.0}, {-1.0}) for s in signs.values())


def test_whitening_equals_the_eigenvectors(spark):
    pick = np.random.default_rng(3)
    spread = np.diag([9.0, 5, 3, 2, 1, 0.5]) @ np.linalg.qr(pick.normal(size=(6, 6)))[0]
    rows = [(i, (pick.normal(size=6) @ spread + 40).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies weigh nothing in the fit
    rows += [(2000, None), (2001, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf] + [0.0] * 5), (2004, [])]
    same_whitening(whitening.whiten(vectors(spark, rows)).collect(), rows)


@pytest.mark.parametrize("last", ["zero", "equal", "sum", "near"])
def test_whitening_without_full_rank(spark, last):
    pick = np.random.default_rng(4)
    rows = []
    for i in range(80):
        a, b = (np.floor(pick.normal(size=2) * 300) / 256).tolist()
        rows.append((i, [a, b, {"zero": 0.0, "equal": a, "sum": a + b, "near": a * 16 + (i % 2) / 256}[last]]))
    same_whitening(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_whitening_of_few_and_mixed_vectors(spark):
    def of(rows):
        return whitening.whiten(vectors(spark, rows)).collect()

    assert of([]) == [] and of([(1, [2.0, 3.0]), (2, [2.0, 3.0])]) == []
    two = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.0])]
    found = of(two)
    assert [(r.id, r.component, abs(round(r.whitened, 12)), round(r.explained, 12)) for r in sorted(found, key=str)] == [
        (1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (None, 1, 1.0, 1.0)
    ]
    long = [(10 + i, [float(i), float(i * i)]) for i in range(5)]
    mixed = of(two + long)
    same_whitening([r for r in mixed if (r.id or 0) >= 10], long)
    assert {r.n for r in mixed} == {2, 5}


def test_huge_vectors_have_no_exact_deviation(spark):
    rows = [(i, [float(3e16 * i), 1.0 * i]) for i in range(3)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.deviation for r in found if r.id in (0, 2)} == {None} and all(math.isfinite(r.whitened) for r in found)
    assert {r.deviation for r in found if r.id == 1} <= {None, 0}


def test_whitening_runs_no_job_for_each_shuffle_partition(spark):
    pick = random.Random(4)
    rows = [(i, [pick.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        start = jobs()
        same_whitening(whitening.whiten(vectors(spark, rows)).collect(), rows)
        assert jobs() - start < 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_whitening_query_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = queries.op11_whitening(spark, SF).withColumnRenamed("vec_id", "id").collect()
    same_whitening(found, [(r.vec_id, r.embedding) for r in rows])


# --- fingerprints --------------------------------------------------------


def slow_print(text):
    votes = [0] * 64
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for term, tf in Counter(re.findall(r"[^\x20\x09-\x0D]+", lowered)).items():
        h, weight = xxhash.xxh64_intdigest(term.encode(), 42), round(8 + 8 * math.log(tf))
        for bit in range(64):
            votes[bit] += weight if h >> bit & 1 else -weight
    value = sum(1 << bit for bit in range(64) if votes[bit] > 0)
    return value - (1 << 64) if value >> 63 else value


def slow_prints(rows):
    """(id, text) pairs of distinct ids."""
    chain = sorted(((i, t or "") for i, t in rows), key=lambda x: -x[0])
    out = {}
    for place, (i, text) in enumerate(chain):
        after = chain[(place + 1) % len(chain)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own, of_edited, of_next = map(slow_print, (text, edited, after))
        near = lambda a, b: 1 - (a ^ b).bit_count() / 64 if (a ^ b) >= 0 else 1 - ((a ^ b) + (1 << 64)).bit_count() / 64
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, of_edited, near(own, of_edited), near(own, of_next))
    return out


def prints_of(df):
    return {r.id: (r.n_chars, r.edited_sha256, r.fp, r.edited_fp, r.near_edited, r.near_next) for r in df.collect()}


def test_fingerprints_equal_the_slow_form(spark, frame, sentence):
    rows = [(3 * i, sentence(5 + i % 40)) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "Ünï Ünï ÉA\x0bé 漢字 \U0001f600 x"), (1004, "a"), (-5, rows[4][1])]
    rows += [(2000, "long " * 40_000 + sentence(20_000))]
    assert prints_of(fingerprints.fingerprints(frame(rows).repartition(7))) == slow_prints(rows)


def test_fingerprints_of_one_and_of_repeated_rows(spark, frame):
    assert fingerprints.fingerprints(frame([])).count() == 0
    one = prints_of(fingerprints.fingerprints(frame([(4, "one two three")])))
    assert one[4][0] == 13 and one[4][-1] == 1.0 and one[4][1] == hashlib.sha256(b"one two tone ").hexdigest()
    repeated = fingerprints.fingerprints(frame([(4, "one two three"), (4, "one two three"), (2, "four five six"), (None, "no id"), (None, "no id"), (2, "other text")]))
    rows = repeated.collect()
    assert len(rows) == 6 and len({tuple(r) for r in rows if r.id == 4}) == 1 and len({tuple(r) for r in rows if r.id is None}) == 1
    assert len({r.fp for r in rows if r.id == 2}) == 2


def test_fingerprints_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    slow = slow_prints(rows)
    found = queries.op12_fingerprints(spark, SF).collect()
    unsigned = lambda v: f"{v % (1 << 64):016x}"
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in found} == {
        i: (n, sha, unsigned(a), unsigned(b), near, after) for i, (n, sha, a, b, near, after) in slow.items()
    }
    for r in found:
        near = sum((int(r.fingerprint, 16) ^ (v[2] % (1 << 64))).bit_count() <= 3 for v in slow.values()) - 1
        assert r.n_near == (near if r.doc_id % 50 == 0 else None)
    texts = dict(rows)
    edited = np.array([r.near_edited for r in found if len((texts[r.doc_id] or "").split()) > 20])
    after = np.array([r.near_next for r in found if len((texts[r.doc_id] or "").split()) > 20])
    assert np.mean(edited > after) > 0.97 and edited.mean() > after.mean() + 0.15


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_block_tables_find_all_within_the_radius(spark, radius):
    pick, signed = random.Random(radius), lambda v: v - (1 << 64) if v >> 63 else v
    values = [pick.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        for flips in range(9):
            for b in pick.sample(range(64), flips):
                v ^= 1 << b
            values.append(v)
    prints = spark.createDataFrame([(signed(v),) for v in values + values[:9]] + [(None,)], "fp long")
    asked = spark.createDataFrame([(signed(v),) for v in values[::7]] + [(signed(values[0]),), (None,)], "query long")
    found = sorted(map(tuple, fingerprints.within(prints, asked, radius).collect()))
    assert found == sorted(
        (signed(q), signed(v), (q ^ v).bit_count()) for q in set(values[::7]) for v in set(values) if (q ^ v).bit_count() <= radius
    )


def test_hot_fingerprints_are_counted_not_listed(spark):
    prints = spark.range(6000).select(F.col("id"), F.when(F.col("id") < 2000, 5).when(F.col("id") < 4000, 7).otherwise(F.col("id") * 1_000_003).alias("fp"))
    counted = fingerprints.with_near_counts(prints, F.col("id") % 1000 == 0, radius=2)
    assert counted.count() == 6000
    assert {r.id: r.n_near for r in counted.filter("n_near is not null").collect()}[0] >= 3999
    assert counted.filter("n_near is not null").count() == 6


def test_fingerprints_are_native(spark, frame):
    df = fingerprints.with_near_counts(fingerprints.fingerprints(frame([(1, "a b"), (2, "c d")])), F.col("id") == 1)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", text)


# --- ranked search -------------------------------------------------------

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_rank(docs, items, k=10):
    bags = [(i, slow_terms(t)) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            tf, m = Counter(bag), 10 + (90 * len(bag) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(slow_terms(text)) if tf[t])
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def ranks(docs, items, **params):
    return sorted(map(tuple, lexical.rank(docs, items, **params).collect()), key=str)


def test_ranked_search_equals_the_slow_form(spark, frame, sentence):
    docs = [(i, sentence(3 + i % 30)) for i in range(200)]
    docs += [(500 + i, docs[3][1]) for i in range(40)]  # one bag, many ids
    docs += [(600 + i, " ".join(reversed(docs[3][1].split())) + "!") for i in range(3)]  # the same bag in other texts
    docs += [(700, None), (701, ""), (702, "-- ..."), (703, "Ünï-KÉ 漢字 x2"), (704, "fox " * 50_000), (705, docs[9][1]), (705, docs[9][1]), (None, docs[5][1])]
    items = [(1, "The QUICK brown fox"), (2, docs[3][1]), (3, None), (4, "zzz"), (5, "ünï 漢字 X2 É"), (None, "lazy dog"), (7, ""), (7, "stars stars stars"), (8, docs[9][1])]
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, term string, score string")
    assert ranks(frame(docs).repartition(5), asked) == slow_rank(docs, items)
    assert ranks(frame(docs).repartition(3), asked, k=2, pairs=5) == slow_rank(docs, items, k=2)


def test_ranked_search_in_whole_numbers_and_many_items(spark, frame, sentence, monkeypatch):
    docs, items = [(i, sentence(20)) for i in range(50)], [(i, sentence(4)) for i in range(9)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "TOGETHER", 4)
    monkeypatch.setattr(lexical, "EXACT", 1)
    assert ranks(frame(docs), asked, k=3) == slow_rank(docs, items, 3)


def test_ranked_search_of_nothing(spark, frame):
    none, one = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert ranks(frame([]), one) == [] and ranks(frame([(1, "fox")]), none) == [] and ranks(frame([(1, "..")]), one) == []


def test_a_class_keeps_its_smallest_ids(spark):
    rows = spark.range(5000).select((5000 - F.col("id")).alias("id"), F.lit(3).cast("long").alias("n"), F.lit(bytes([0, 0, 0, 0, 2, 0, 0, 0])).alias("bag"))
    (one,) = lexical.classes(rows, 5000, 15_000, 10).collect()
    assert one["size"] == 5000 and one.ids == list(range(1, 11))
