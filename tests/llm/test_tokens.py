import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spendlens.llm import bpe, id_coder, packing
from spendlens.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    None,
    "",
    " \t\n",
    "Hello wörld <|endoftext|>it's 123 x_y! <|startoftext|><|EndOfText|> <|",
    "ΣΊΣΥΦΟΣ İstanbul été \x1cA\x1fB\x85C\xa0D E​F ﻿",
    "日本語のテキスト 🙂🙂 don't we'll I'M ٣٤ Ⅷ ½",
    "a" * 3000,
    "word " * 20_000,
    "ﬁne ﬃ Å Å ẞ ŉ Ǆ",
]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoding_and_decoding_as_the_library(frame):
    rows = [*enumerate(ODD), (None, "nameless"), (3, ODD[3])]
    got = bpe.encode_decode(frame(rows), PATH).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    for r in got:
        ids = library(texts[r.id])
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(frame([]), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_encoding_of_any_text(text):
    memo = bpe.load(PATH)[1]
    assert np.frombuffer(memo.text(text), "<u4").tolist() == library(text)


@pytest.mark.parametrize("n, block", [(0, 7), (1, 7), (7, 7), (50, 7), (5000, 2048)])
def test_ids_come_back(n, block):
    pick = random.Random(n)
    ids = np.array([pick.choice([0, 1, 65535, 300, pick.randrange(1 << 16)]) for _ in range(n)], "<u4")
    data = id_coder.encode(ids, block)
    assert id_coder.decode(data).tolist() == ids.tolist()


def test_repetition_is_predicted():
    assert len(id_coder.encode(np.array([5, 49000, 777] * 1000, "<u4"))) < 700


def test_blocks_are_independent_and_checked():
    ids = np.arange(40, dtype="<u4") * 977
    data = id_coder.encode(ids, 10)
    first = id_coder.HEAD.size + id_coder.HEAD.unpack_from(data)[2]
    assert id_coder.decode(data[first:]).tolist() == ids[10:].tolist()
    for at in (0, id_coder.HEAD.size + 3, len(data) - 9):
        with pytest.raises(ValueError):
            id_coder.decode(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])
    with pytest.raises(ValueError):
        id_coder.encode(np.array([1 << 16], "<u4"))


def test_files_hold_ids_in_order(frame):
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD * 3)] + [(None, "nameless one"), (None, None), (3, "again"), (3, "again")]
    files = id_coder.write_ids(frame(rows).repartition(5), PATH, end_id=2)
    got = sorted(id_coder.read_digests(files).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at, texts = 0, {}
    for i, t in rows:
        ids = np.array([*library(t), 2], "<u4")
        texts.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in texts[r.id]
        at += r.n_tokens
    assert id_coder.read_digests(id_coder.write_ids(frame([]), PATH)).count() == 0


def least_size(n, sizes, costs):
    return min((c, s) for s, c in zip(sizes, costs) if s >= n)


def slow_pack(lengths, sizes, costs, choice):
    """Best fit by looking at every open bin, sizes opened from ``choice``."""
    waiting, bins, clock = sorted(lengths, reverse=True), [], 0

    def fill(room):
        held = 0
        for n in waiting:
            if n <= room - held:
                held += n
        return held

    while waiting:
        n, clock = waiting.pop(0), clock + 1
        if fitting := [b for b in bins if b["room"] >= n]:
            at = min(fitting, key=lambda b: (b["room"], -b["changed"]))
        else:
            offers = [(least_size(n + fill(s - n), sizes, costs)[0] / (n + fill(s - n)), -s) for s in choice if s >= n]
            at = {"room": -min(offers)[1], "held": []}
            bins.append(at)
        at["room"] -= n
        at["held"].append(n)
        at["changed"] = clock
    return [b["held"] for b in bins]


def cost_of(bins, sizes, costs):
    return sum(least_size(sum(held), sizes, costs)[0] for held in bins)


def exhaustive(lengths, sizes, costs):
    """Least cost over all ways to part the lengths."""
    best = [float("inf")]

    def place(rest, bins):
        if not rest:
            best[0] = min(best[0], cost_of(bins, sizes, costs))
            return
        for k, held in enumerate(bins):
            if sum(held) + rest[0] <= max(sizes):
                place(rest[1:], [*bins[:k], [*held, rest[0]], *bins[k + 1 :]])
        place(rest[1:], [*bins, [rest[0]]])

    place(sorted(lengths, reverse=True), [])
    return best[0] if lengths else 0


def packed(lengths, sizes, costs):
    bins, offsets, capacity = packing.best_fit(np.array(lengths, np.int64), sizes, costs)
    made = {}
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
        made.setdefault(b, []).append((o, n))
    for b, held in made.items():
        held.sort()
        assert all(o == sum(n for _, n in held[:i]) for i, (o, _) in enumerate(held))
        assert capacity[b] == least_size(sum(n for _, n in held), sizes, costs)[1]
    return [[n for _, n in held] for held in made.values()], capacity


KINDS = {"flat": lambda s: 64 + s, "slots": lambda s: s, "steep": lambda s: 10 + s * s, "shipped": lambda s: 8 + s + s * s / 40}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.sampled_from(sorted(KINDS)))
def test_packing_as_brute_force(lengths, kind):
    sizes = (10, 20, 40)
    costs = tuple(map(KINDS[kind], sizes))
    got, _ = packed(lengths, sizes, costs)
    choices = [sizes, *((s,) for s in sizes if s >= max(lengths, default=0))]
    slow = [slow_pack(lengths, sizes, costs, c) for c in choices]
    least = min(cost_of(s, sizes, costs) for s in slow)
    assert cost_of(got, sizes, costs) == pytest.approx(least)
    assert sorted(map(sorted, got)) in [sorted(map(sorted, s)) for s in slow]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8), st.sampled_from(sorted(KINDS)))
def test_packing_is_near_the_least_cost(lengths, kind):
    sizes = (10, 20, 40)
    costs = tuple(map(KINDS[kind], sizes))
    got, _ = packed(lengths, sizes, costs)
    assert cost_of(got, sizes, costs) <= 1.5 * exhaustive(lengths, sizes, costs) + 1e-9


def test_several_sizes_are_opened():
    lengths = np.minimum(8192, np.random.default_rng(4).lognormal(6, 1.2, 20_000).astype(np.int64) + 1).tolist()
    got, capacity = packed(lengths, packing.SIZES, packing.COSTS)
    shares = [capacity.count(s) for s in packing.SIZES]
    assert sum(n > 50 for n in shares) >= 3
    cost = cost_of(got, packing.SIZES, packing.COSTS)
    order = np.argsort(-np.array(lengths), kind="stable").tolist()
    cheapest = [least_size(n, packing.SIZES, packing.COSTS) for n in range(8193)]
    for size in packing.SIZES:
        if size >= max(lengths):
            _, _, used = packing._plan(np.array(lengths), order, (size,), cheapest)
            assert cost <= sum(cheapest[n][0] for n in used)


def test_every_word_has_one_place(frame):
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("w")) + 1
    rows = [(i % 7 or None, "w " * (i * 37 % 500)) for i in range(200)] + [(300, "w " * 30_000), (301, None), (302, "")]
    got = packing.pack(frame(rows).repartition(3), n_words, window=64).collect()
    assert sum(r.n_tokens for r in got) == sum((t or "").count("w") + 1 for _, t in rows)
    assert [(r.piece, r.start, r.n_tokens) for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 300] == [
        (0, 0, 8192), (1, 8192, 8192), (2, 16384, 8192), (3, 24576, 5425)
    ]
    bins = {}
    for r in got:
        bins.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.n_tokens))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), held in bins.items():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= capacity == next(s for s in packing.SIZES if s >= end)
    assert packing.pack(frame([]), n_words).count() == 0


def test_slots_are_tokens(spark, frame, tmp_path):
    rows = [(1, "語" * 9000), (2, "Zm9vYmFy" * 3000), (3, "a few words, plainly"), (4, None), (5, ""), (6, "x" * 20 + " 1234")]
    docs = frame(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: len(library(t or "")) + 1 for i, t in rows}
    assert want[1] > 8192 and want[2] > 8192
    for made in (QUERIES["op2_packing"](spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        got = {}
        for r in made.collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
            assert r.bin_offset + r.n_tokens <= r.capacity <= 8192
        assert got == want


def test_ids_over_16_bits(frame):
    pick = random.Random(8)
    for symbols in (5, 8):
        ids = np.array([pick.choice([0, 65536, 16**symbols - 1, pick.randrange(16**symbols)]) for _ in range(300)], "<u4")
        assert id_coder.symbols_for(ids.max()) == symbols
        data = id_coder.encode(ids, 70, symbols) + id_coder.encode(ids & 0xFFFF, 70)
        assert id_coder.decode(data).tolist() == [*ids.tolist(), *(ids & 0xFFFF).tolist()]
    end = 1 << 20
    files = id_coder.write_ids(frame([(1, "some words"), (2, None)]), PATH, end_id=end)
    want = {i: zlib.crc32(np.array([*library(t), end], "<u4").tobytes()) for i, t in ((1, "some words"), (2, ""))}
    assert {r.id: r.ids_crc32 for r in id_coder.read_digests(files).collect()} == want


def zipf_ids(n, seed):
    made = np.random.default_rng(seed)
    return (np.minimum(made.zipf(1.3, n), 7000) * 7 + made.integers(0, 7, n)).astype("<u4")


def test_coding_takes_about_a_microsecond_an_id():
    ids = zipf_ids(400_000, 1)
    began = time.process_time()
    assert np.array_equal(id_coder.decode(id_coder.encode(ids)), ids)
    assert time.process_time() - began < 2e-6 * len(ids)


def test_order_0_learns_frequent_ids():
    # Eight ids, each as likely as the others whatever went before: three bits an id, and little for the start of a block.
    ids = np.random.default_rng(2).choice(np.arange(8) * 6007 + 11, 2048).astype("<u4")
    assert len(id_coder.encode(ids)) < 2048 * 3 / 8 + 200


@pytest.mark.parametrize("symbols, top", [(4, 65_535), (8, 2**32 - 1)])
def test_largest_ids_and_blocks_of_all_lengths_come_back(symbols, top):
    # Copies with changes, so that every order names ids; each length stands alone and beside others.
    made = np.random.default_rng(symbols)
    part = made.integers(0, top, 40, endpoint=True)
    ids = np.concatenate([np.where(made.random(40) < 0.1, top, part) for _ in range(60)]).astype("<u4")
    pieces = [ids[: made.integers(1, len(ids))] for _ in range(20)]
    coded = [id_coder.encode(p, int(made.integers(1, 900)), symbols) for p in pieces]
    assert np.array_equal(id_coder.decode(b"".join(coded)), np.concatenate(pieces))
    for p, c in zip(pieces, coded):
        assert np.array_equal(id_coder.decode(c), p)


def test_block_of_too_many_ids_is_refused():
    for block in (0, id_coder.MOST + 1):
        with pytest.raises(ValueError):
            id_coder.encode(zipf_ids(10, 3), block)
    assert np.array_equal(id_coder.decode(id_coder.encode(zipf_ids(9000, 3), id_coder.MOST)), zipf_ids(9000, 3))


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_words_have_the_ids_of_the_whole_library(text):
    memo = id_coder._tokens(PATH)
    assert np.frombuffer(memo.text(text), "<u4").tolist() == library(text)
    for word in bpe.words(text + " \x00 \x1c\x7f it'll 'x"):
        assert memo.encode_word(word) == library(word)
