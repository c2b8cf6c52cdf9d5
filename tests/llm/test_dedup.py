import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import components, line_dedup, simhash
from spendlens.llm.common import dealt_join

LONG = "  This line is long enough to count\t"
CASES = [
    (1, f"{LONG}\nown\n\n{LONG}"),
    (2, "THIS LINE IS LONG ENOUGH TO COUNT\nown"),
    (3, "this line is long enough to count\nÉtait une ligne assez longue ici"),
    (4, None),
    (5, ""),
    (6, "own\nown\nown"),
    (7, "x" * 300_000 + "\n" + LONG),
    (7, "x" * 300_000 + "\n" + LONG),
    (None, f"{LONG}\nrest"),
    (None, None),
    (8, "étaIT une ligne assez longue ici\n" + "many words " * 30),
    (9, "Était UNE ligne assez longue ici\n"),
]


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                held.setdefault(key(line), set()).add(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [CASES, [], [(None, None)], CASES * 2])
def test_lines_as_brute_force(frame, rows):
    got = line_dedup.drop_shared_lines(frame(rows))
    assert got.select("row.*").columns == frame([]).columns
    assert sorted(((r.row.doc_id, r.row.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute_lines(rows)


def test_lines_stay_in_the_jvm(frame):
    plan = line_dedup.drop_shared_lines(frame(CASES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def near(a, b, bits=4):
    return bin((a ^ b) & (2**64 - 1)).count("1") <= bits


def brute_groups(prints):
    """Smallest index reachable from each."""
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(prints)), 2):
            if near(prints[i], prints[j]) and group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    return group


def prints_around(n, seed):
    """Chains, clusters and strangers, with repeats."""
    pick = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        at = int(pick.integers(0, 2**63)) * 2 + int(pick.integers(0, 2))
        for _ in range(int(pick.integers(1, 12))):
            out.append(at)
            for bit in pick.integers(0, 64, int(pick.integers(0, 7))):
                at ^= 1 << int(bit)
    return [p - 2**64 if p >= 2**63 else p for p in out[:n]]


@pytest.mark.parametrize("width, cap", [(3, 4096), (4, 4096), (3, 3), (2, 1)])
def test_links_connect_what_is_near(spark, width, cap):
    prints = prints_around(150, 3)
    df = spark.createDataFrame([(p,) for p in set(prints)], "fp long")
    links = simhash.near_links(df, 4, width, cap)
    assert all(near(r.a, r.b) for r in links.collect()) or cap < 4096
    roots = {r.node: r.root for r in components.components(links).collect()}
    want = brute_groups(prints)
    for i, j in itertools.combinations(range(len(prints)), 2):
        same = roots.get(prints[i], prints[i]) == roots.get(prints[j], prints[j])
        assert same == (want[i] == want[j])


def test_groups_of_positions_cover():
    for bits, width in ((4, 1), (4, 2), (4, 3), (4, 4), (2, 3)):
        groups = [set(g) for g in simhash.index_groups(width, bits)]
        for equal in itertools.combinations(range(8), 8 - bits):
            assert any(g <= set(equal) for g in groups)
    assert len(simhash.index_groups(3, 4)) == 20
    with pytest.raises(ValueError):
        simhash.index_groups(5, 4)


def test_dense_cluster_gives_a_tree_not_all_pairs(spark):
    base = 0x0123456789ABCDEF
    prints = [base] + [base ^ (1 << i) ^ (1 << j) for i, j in itertools.combinations(range(32), 2)]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert links.count() <= 20 * len(prints)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(spark, text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    rows = spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()
    return sum(1 << b for b in range(64) if 2 * sum((r.h >> b) & 1 for r in rows) > len(rows))


def test_fingerprint_is_a_bitwise_majority(spark, sentence):
    for text in ("", None, " \t\n", "One", "one two THREE", "a b c d", "Été à la plage, déjà vu", sentence(40), "a\tb\n" + sentence(9)):
        assert simhash.fingerprint(text, 4) == slow_fingerprint(spark, text)


def test_one_of_each_group(frame, sentence):
    text = sentence(60)
    rows = [(3, text), (2, text), (2, text), (None, text), (9, text + " end"), (4, ""), (6, None), (None, None)]
    rows += [(None, "quite another text of some words"), (None, "quite another text of some words"), (7, sentence(50)), (8, "y " * 100_000)]
    groups = {(r.id, r.fp): r.component_id for r in simhash.near_groups(frame(rows)).collect()}
    prints = [(i, (p := simhash.fingerprint(t, 4)) - (2**64 if p >= 2**63 else 0)) for i, t in rows]
    reach = brute_groups([p for _, p in prints])
    for at, key in enumerate(prints):
        ids = [i for (i, _), g in zip(rows, reach) if g == reach[at] and i is not None]
        assert groups[key] == (min(ids) if ids else None)
    kept = simhash.one_of_each_group(frame(rows))
    assert kept.columns == frame([]).columns
    assert kept.count() == len(set(reach))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted({min(i for (i, _), h in zip(rows, reach) if h == g and i is not None) for g in set(reach) if any(i is not None for (i, _), h in zip(rows, reach) if h == g)})
    assert simhash.near_groups(frame([])).count() == simhash.one_of_each_group(frame([])).count() == 0


def test_kept_digest_of_nothing(frame):
    row = line_dedup.drop_shared_lines(frame([(1, None)])).select(F.sha2("row.text", 256).alias("d")).first()
    assert row.d == hashlib.sha256(b"").hexdigest()


def test_rows_of_a_hot_key_are_dealt_to_several_tasks(spark):
    rows = spark.createDataFrame([(1, i) for i in range(400)] + [(i, i) for i in range(2, 60)] + [(99, None)], "a long, b long")
    known = rows.groupBy("a").agg(F.max("b").alias("m"))
    wide = dealt_join(rows.hint("merge"), known, "a", "b")
    assert sorted(wide.collect(), key=str) == sorted(rows.join(known, "a").collect(), key=str)
    assert wide.columns == ["a", "b", "m"]
    parts = spark.createDataFrame([(i,) for i in range(400)], "b long").select(F.pmod(F.xxhash64(F.lit(5), "b"), F.lit(8)).alias("s"))
    assert max(r["count"] for r in parts.groupBy("s").count().collect()) < 100
