"""Token ids in files: an adaptive context-mixing range coder over independent blocks."""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendlens.llm.bpe import Memo, byte_symbols
from spendlens.llm.common import stored

#: Ids of a block and the most that it may have, blocks that are coded side by side, and ids of a chunk, which is one row of a file.
BLOCK, MOST, LANES, CHUNK = 2048, 8192, 2048, 1 << 22
#: A block: mark, ids, bytes of payload, checksums of the ids and of the payload, ids written as they are, four-bit symbols of an id.
#: The payload: the ids written as they are, then the 16-bit words of the range coder.
HEAD = struct.Struct("<4sIIIIIB")
MARK = b"CMR3"

# An id is coded in one step, by which order has it: order 2 and 1 name the id that followed their context last (the two ids before, or the
# one), order 0 knows how often the block has had each id. An id that none of them has is written as it is. Contexts are hashed into 2**PLACES.
SYMBOLS, PLACES, TOTAL = 4, (10, 11), 20
ORDER0, NEW, ORDER1, ORDER2 = range(4)
CONTEXTS, LEAST = 16, 16  # LEAST of 2**TOTAL is the narrowest interval that leaves the coder a word to go on with.
# What an order counts before it was right once, by context: nothing where it names no id.
_PRIOR = np.array([[2] * CONTEXTS, [2] * CONTEXTS, [0, 2] * 8, [0, 0, 2, 2] * 4], np.int64)[:, :, None]


def _learns(n: int) -> list[int]:
    """The places in a block before which the counts so far are taken up."""
    out = [16]
    while out[-1] < n:
        out.append(2 * out[-1] if out[-1] < 128 else 7 * out[-1] // 4)
    return out[:-1]


class _Named:
    """The id after each context of order 1 and 2 (plus one; 0: none yet, so the largest id of its width is never named), for blocks side by side."""

    def __init__(self, lanes: int, kind: str):
        self.lanes, each = lanes, np.arange(lanes, dtype=np.uint32)
        self.table = np.zeros(sum(lanes << p for p in PLACES), kind)
        self.base1, self.base2 = each << np.uint32(PLACES[0]), (each << np.uint32(PLACES[1])) + np.uint32(lanes << PLACES[0])
        self.places, self.after = np.empty(2 * lanes, np.intp), np.empty(2 * lanes, kind)

    def look_up(self, before: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """What order 1 names in all blocks, then what order 2 names."""
        self.places[: self.lanes] = (before * np.uint32(0x9E3779B1) >> np.uint32(32 - PLACES[0])) + self.base1
        mixed = before * np.uint32(0x85EBCA77) + earlier * np.uint32(0xC2B2AE3D)
        self.places[self.lanes :] = (mixed >> np.uint32(32 - PLACES[1])) + self.base2
        return self.table.take(self.places, mode="clip")

    def learn(self, ids: np.ndarray) -> None:
        np.add(ids, 1, out=self.after[: self.lanes], casting="unsafe")
        self.after[self.lanes :] = self.after[: self.lanes]
        self.table[self.places] = self.after


class _Shares:
    """How often each order was right in each context, and the part of the coder's interval that it gets for that."""

    def __init__(self, lanes: int):
        self.lanes, self.counts = lanes, np.zeros((4, CONTEXTS, lanes), np.int64)
        self.divide(0)

    def learn(self, cells: np.ndarray, known: int) -> None:
        """Count ``cells`` (which order was right, in which context); the blocks have had ``known`` ids."""
        places = cells * np.int64(self.lanes) + np.arange(self.lanes)
        self.counts += np.bincount(places.ravel(), minlength=self.counts.size).reshape(self.counts.shape)
        self.divide(known)

    def divide(self, known: int) -> None:
        weight = 8 * self.counts + _PRIOR
        weight[ORDER0] *= known > 0
        free = (1 << TOTAL) - LEAST * (known + 3)
        share = LEAST + free * weight // weight.sum(axis=0)
        two = share[ORDER2]
        one = two + share[ORDER1]
        new = one + share[NEW] if known else np.full_like(one, 1 << TOTAL)
        #: Ends of the parts of order 2, of order 1 and of new ids; order 0 has the rest, so much (unit) for each id it knows.
        unit = np.maximum(((1 << TOTAL) - new) // max(known, 1), LEAST)
        self.ends = tuple(part.astype(np.int32).ravel() for part in (two, one, new, unit))

    def of(self, context: np.ndarray) -> list[np.ndarray]:
        """Ends of the parts of order 2, order 1 and new ids, and the unit of order 0, in these contexts of the blocks."""
        place = context * np.int64(self.lanes) + np.arange(self.lanes)
        return [part.take(place, mode="clip") for part in self.ends]


def _encode_side_by_side(blocks: list[np.ndarray], symbols: int) -> list[tuple[bytes, int]]:
    sizes = np.array([len(b) for b in blocks])
    n, lanes = int(sizes.max()), len(blocks)
    by_lane = _unaligned(lanes, n, np.uint32)
    for i, b in enumerate(blocks):
        by_lane[i, : len(b)] = b
    ids = np.ascontiguousarray(by_lane.T)
    named, found = _Named(lanes, _plain(symbols)), np.empty((n, 2, lanes), _plain(symbols))
    before = earlier = np.zeros(lanes, np.uint32)
    for t in range(n):
        found[t] = named.look_up(before, earlier).reshape(2, lanes)
        named.learn(ids[t])
        earlier, before = before, ids[t]
    one, two, after = found[:, 0], found[:, 1], (ids + np.uint32(1)).astype(_plain(symbols))
    hit2 = (two == after) & (two != 0)
    hit1 = (one == after) & (one != 0) & ~hit2
    context = _contexts(one, two, _runs(hit1 | hit2))
    del named, found, one, two, after

    # Order 0 counts by the rank of an id among all of its block, so that the decoder's counts, which are sorted by id, are the same.
    wide = np.uint32 if symbols <= 4 else np.uint64
    key = by_lane.astype(wide) << wide(13)
    key |= np.arange(n, dtype=wide)
    key.sort(axis=1)
    fresh = np.zeros((lanes, n), bool)
    np.greater(key[:, 1:] ^ key[:, :-1], wide(0x1FFF), out=fresh[:, 1:])
    ranked = np.cumsum(fresh, axis=1, dtype=np.int32)
    ranks = int(ranked[:, -1].max()) + 1
    ranked += np.arange(lanes, dtype=np.int32)[:, None] * np.int32(ranks)
    rank = _unaligned(lanes, n, np.int32)
    np.put_along_axis(rank, (key & wide(0x1FFF)).astype(np.intp), ranked, axis=1)
    rank = np.ascontiguousarray(rank.T)
    del key, fresh, ranked, by_lane

    shares, seen = _Shares(lanes), np.zeros(lanes * ranks, np.int32)
    start, width, new = np.empty((n, lanes), np.int32), np.empty((n, lanes), np.int32), np.empty((n, lanes), bool)
    smaller = seen
    for a, b in zip([0, *_learns(n)], [*_learns(n), n]):
        count = seen.take(rank[a:b])
        kind = np.where(count > 0, np.uint8(ORDER0), np.uint8(NEW))
        kind[hit1[a:b]] = ORDER1
        kind[hit2[a:b]] = ORDER2
        new[a:b] = kind == NEW
        first, second, third, unit = shares.of(context[a:b])
        start[a:b] = third + unit * smaller.take(rank[a:b])
        width[a:b] = unit * count
        for which, begin, end in ((new[a:b], second, third), (hit1[a:b], first, second), (hit2[a:b], np.zeros_like(first), first)):
            np.copyto(start[a:b], begin, where=which, casting="same_kind")
            np.copyto(width[a:b], end - begin, where=which, casting="same_kind")
        if b < n:
            shares.learn(kind * np.uint8(CONTEXTS) + context[a:b], b)
            seen += np.bincount(rank[a:b].ravel(), minlength=seen.size).astype(np.int32)
            smaller = np.cumsum(seen.reshape(lanes, ranks), axis=1, dtype=np.int32).ravel() - seen
    del context, rank, hit1, hit2

    # The range coder: 48 bits, of which 16 leave as soon as the span is under 32. A carry into words that have left is added at the end.
    low, span, last = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64), np.zeros(lanes, np.int64)
    words, sent, ending = np.empty((n, lanes), np.uint32), np.empty((n, lanes), bool), set(sizes.tolist())
    for t in range(n):
        step = span >> TOTAL
        low += step * start[t]
        span = step * width[t]
        out = span < 1 << 32
        words[t] = low >> 32
        sent[t] = out
        low = np.where(out, (low & 0xFFFFFFFF) << 16, low)
        span = np.where(out, span << 16, span)
        if t + 1 in ending:
            last = np.where(sizes == t + 1, (low + 0xFFFFFFFF) >> 32, last)
    alive = np.arange(n)[:, None] < sizes
    sent &= alive
    new &= alive
    every = np.vstack([words, last[None].astype(np.uint32)]).T[np.vstack([sent, np.ones((1, lanes), bool)]).T]
    while (carry := every >> np.uint32(16)).any():
        every &= np.uint32(0xFFFF)
        every[:-1] += carry[1:]
    every = every.astype("<u2")
    plain = ids.T[new.T].astype(_plain(symbols))
    word_ends, plain_ends = np.cumsum(sent.sum(axis=0) + 1).tolist(), np.cumsum(new.sum(axis=0)).tolist()
    return [
        (plain[p:q].tobytes() + every[a:b].tobytes(), q - p)
        for p, q, a, b in zip([0, *plain_ends], plain_ends, [0, *word_ends], word_ends)
    ]


def _plain(symbols: int) -> str:
    return "<u2" if symbols <= 4 else "<u4"


def _unaligned(rows: int, columns: int, kind) -> np.ndarray:
    """Rows that don't lie a power of two apart, as reading down their columns is slow then."""
    return np.zeros((rows, columns + 16), kind)[:, :columns]


def _runs(hit: np.ndarray) -> np.ndarray:
    """How many of the ids just before were named by order 1 or 2, three at most."""
    out = np.zeros(hit.shape, np.uint8)
    run = np.ones_like(hit)
    for back in (1, 2, 3):
        run = run[1:] & hit[: len(hit) - back] if back == 1 else run[1:] & hit[: max(len(hit) - back, 0)]
        out[back:] += run
    return out


def _contexts(one: np.ndarray, two: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The context of the shares: the run, whether order 2 names an id, and whether order 1 names another."""
    return run * np.uint8(4) + (two != 0) * np.uint8(2) + ((one != 0) & (one != two))


@np.errstate(divide="ignore", invalid="ignore")  # of what follows the end of a block
def _decode_side_by_side(payloads: list[tuple[bytes, int]], sizes: np.ndarray, symbols: int) -> list[np.ndarray]:
    n, lanes, kind = int(sizes.max()), len(payloads), np.dtype(_plain(symbols))
    split = [k * kind.itemsize for _, k in payloads]
    # A block's words are followed by zeros; each block starts with the 48 bits that the coder looks at.
    pieces = [np.frombuffer(p, "<u2", offset=s) for (p, _), s in zip(payloads, split)]
    lengths = np.array([len(p) + 3 for p in pieces])
    words = np.zeros(int(lengths.sum()), np.uint16)
    at = np.cumsum(lengths) - lengths
    for a, p in zip(at.tolist(), pieces):
        words[a : a + len(p)] = p
    plain = np.frombuffer(b"".join(p[:s] for (p, _), s in zip(payloads, split)) or bytes(4), kind).astype(np.uint32)
    next_plain = np.cumsum([0, *(k for _, k in payloads[:-1])])
    code = np.zeros(lanes, np.int64)
    for i in range(3):
        code = code << 16 | words[at + i]
    at += 3
    span = np.full(lanes, 1 << 48, np.int64)

    ids, cells = _unaligned(n, lanes, kind), np.empty((n, lanes), np.uint8)
    lane, base0 = np.arange(lanes), np.zeros(lanes, np.int64)
    shares, known, entries, named = _Shares(lanes), 0, np.ones(1, np.int64), _Named(lanes, kind)
    before = earlier = np.zeros(lanes, np.uint32)
    run, learns = np.zeros(lanes, np.uint8), set(_learns(n))
    for t in range(n):  # a block that has ended goes on with what comes, which is dropped
        if t in learns:
            shares.learn(cells[known:t], t)
            known, base0 = t, lane * t
            entries = _known_ids(ids[:t])
        found = named.look_up(before, earlier)
        one, two = found[:lanes], found[lanes:]
        context = _contexts(one, two, run)
        first, second, third, unit = shares.of(context)
        step = span >> TOTAL
        # Quotients of less than 2**21 are exact in doubles, as the divisors are under 2**32.
        value = (code / step).astype(np.int32)
        is2, is1, named_or_new = value < first, value < second, value < third
        slot = ((value - third) / unit).astype(np.int64)
        entry = entries.take(slot + base0, mode="clip")
        # Little-endian halves: the id is above, how many are smaller and how often it is there below.
        low, now = entry.view(np.uint32)[::2], entry.view(np.uint32)[1::2]
        count, smaller = (low & 0xFFFF).astype(np.int32), (low >> 16).astype(np.int32)
        start = np.where(named_or_new, np.where(is1, np.where(is2, 0, first), second), third + unit * smaller)
        width = np.where(named_or_new, np.where(is1, np.where(is2, first, second - first), third - second), unit * count)
        now = np.where(is1, np.where(is2, two, one) - kind.type(1), now)
        fresh = np.flatnonzero(named_or_new > is1)
        if len(fresh):
            now[fresh] = plain.take(next_plain[fresh], mode="clip")
            next_plain[fresh] += 1
        code -= step * start
        span = step * width
        out = span < 1 << 32
        code = np.where(out, code << 16 | words.take(at, mode="clip"), code)
        span = np.where(out, span << 16, span)
        at += out
        ids[t] = now
        named.learn(now)
        cells[t] = context + (named_or_new.view(np.uint8) + is1 + is2) * np.uint8(CONTEXTS)
        run = np.minimum(run + np.uint8(1), np.uint8(3)) * is1
        earlier, before = before, now
    rows = np.ascontiguousarray(ids.T).astype("<u4", copy=False)
    return [rows[i, :k] for i, k in enumerate(sizes.tolist())]


def _known_ids(ids: np.ndarray) -> np.ndarray:
    """The ids of each block so far, sorted; each with how many are smaller and how often it is there (32, 16 and 16 bits)."""
    known, lanes = ids.shape
    rows = np.sort(np.ascontiguousarray(ids.T), axis=1)
    fresh = np.ones((lanes, known), bool)
    np.not_equal(rows[:, 1:], rows[:, :-1], out=fresh[:, 1:])
    starts = np.flatnonzero(fresh)
    counts = np.diff(starts, append=lanes * known)
    return np.repeat(rows.ravel()[starts].astype(np.int64) << 32 | starts % known << 16 | counts, counts)


def symbols_for(largest: int) -> int:
    """Symbols of the ids of a vocabulary whose largest id is given."""
    return max(SYMBOLS, -(-int(largest).bit_length() // 4))


def encode(ids: np.ndarray, block: int = BLOCK, symbols: int = SYMBOLS) -> bytes:
    """Blocks of ``block`` ids each, of ``symbols`` four-bit symbols, coded from a fresh state and checksummed."""
    if len(ids) and int(ids.max()) >= 16**symbols:
        raise ValueError(f"ids have to fit {4 * symbols} bits")
    if not 0 < block <= MOST:
        raise ValueError(f"a block has 1 to {MOST} ids")
    blocks = [ids[i : i + block] for i in range(0, len(ids), block)]
    out = []
    for i in range(0, len(blocks), LANES // 4):  # fewer than are decoded, as it takes more memory
        side = blocks[i : i + LANES // 4]
        for b, (payload, plain) in zip(side, _encode_side_by_side(side, symbols)):
            out += [HEAD.pack(MARK, len(b), len(payload), zlib.crc32(b.astype("<u4").tobytes()), zlib.crc32(payload), plain, symbols), payload]
    return b"".join(out)


def decode(data: bytes) -> np.ndarray:
    """The ids of ``encode``'s blocks; fails where a block's mark or checksum is wrong."""
    heads, payloads, at = [], [], 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError("damaged block")
        mark, n, size, crc, payload_crc, plain, symbols = HEAD.unpack_from(data, at)
        at += HEAD.size
        payload = data[at : at + size]
        if mark != MARK or len(payload) < size or not SYMBOLS <= symbols <= 8 or not 0 < n <= MOST or plain > n or zlib.crc32(payload) != payload_crc:
            raise ValueError("damaged block")
        heads.append((n, crc, symbols))
        payloads.append((payload, plain))
        at += size
    out: list = [None] * len(heads)
    for symbols in {h[2] for h in heads}:
        alike = [i for i, h in enumerate(heads) if h[2] == symbols]
        for start in range(0, len(alike), LANES):
            side = alike[start : start + LANES]
            found = _decode_side_by_side([payloads[i] for i in side], np.array([heads[i][0] for i in side]), symbols)
            for i, ids in zip(side, found):
                if zlib.crc32(ids.tobytes()) != heads[i][1]:
                    raise ValueError("checksum of a block differs")
                out[i] = ids
    return np.concatenate(out) if out else np.empty(0, "<u4")


@lru_cache(maxsize=2)
def _tokens(path: str) -> Memo:
    """The library's ids of words, and of whole texts where they hold special tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    model, symbols = tokenizer.model, byte_symbols()

    def word_ids(word: str) -> list[int]:
        # A word is normalised and parted already; the library's model takes its bytes as symbols, most of which stand for themselves.
        if not (word.isascii() and word.isprintable()):
            word = "".join([symbols[b] for b in word.encode("utf-8", "surrogatepass")])
        return [token.id for token in model.tokenize(word)]

    memo = Memo(word_ids, lambda text: tokenizer.encode(text, add_special_tokens=False).ids)
    memo.largest = max(tokenizer.get_vocab().values())
    return memo


def _writer(path: str, end_id: int):
    def written(batches):
        part, seq, held, lengths, total = TaskContext.get().partitionId(), 0, [], [], 0
        names = []
        end = np.array([end_id], "<u4").tobytes()

        def flush():
            ids = np.frombuffer(b"".join(held), "<u4")
            columns = [[part], [seq], [len(ids)], [names], [lengths], [encode(ids, symbols=symbols)]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "seq", "n", "ids", "lengths", "data"])

        memo = _tokens(path)
        symbols = symbols_for(max(memo.largest, end_id))
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("id").type
            for name, text in zip(batch.column("id"), batch.column("text")):
                held.append(memo.text(text.as_py()) + end)
                names.append(name.as_py())
                lengths.append(len(held[-1]) // 4)
                total += lengths[-1]
                if total >= CHUNK:
                    yield flush()
                    seq, held, names, lengths, total = seq + 1, [], [], [], 0
        if held:
            yield flush()

    return written


def write_ids(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token ids of ``docs`` to files in the order of their ids; gives the file rows, read back.

    Files lie in the shared folder, written by Spark. A row (part, seq, n, ids,
    lengths, data) is a chunk of whole documents, their ids coded in ``data``.
    Documents are ordered by ``id_col``, NULL first, ties by a hash of the text.
    Ranges are cut by id and that hash, so an id that many rows repeat is split;
    a task holds one chunk.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    schema = f"part long, seq long, n long, ids array<{kind}>, lengths array<long>, data binary"
    return stored(ordered.mapInArrow(_writer(path, end_id), schema), "token-ids")


def read_digests(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the decoded files."""
    # Two steps: parts are few, and the chunks of one part are summed among themselves.
    before_part = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", before_part.alias("before"))
    before_chunk = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("part", "seq", "n").select("part", "seq", before_chunk.alias("inside")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("inside") + F.col("before")).alias("base"))
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def read(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data = decode(batch.column("data")[row].as_py())
                lengths = np.array(batch.column("lengths")[row].as_py(), np.int64)
                ends = np.cumsum(lengths)
                digests = [zlib.crc32(data[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[row].values,
                        pa.array(np.full(len(ends), batch.column("part")[row].as_py())),
                        pa.array(np.full(len(ends), batch.column("seq")[row].as_py())),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array(digests, pa.int64()),
                    ],
                    names=["id", "part", "seq", "inside", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "seq", "ids", "lengths", "data").mapInArrow(
        read, f"id {kind}, part long, seq long, inside long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["part", "seq"]).select("id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
