"""BPE encoding and decoding for a word-level vocabulary in the tokenizers JSON format."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import slices

#: Characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern whose matches are the words of a text, with its class \s spelled out.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: The same for texts of characters below U+0180, which NFC leaves alone, once in lower case: the classes are short there.
#: Letters come first, as most words are letters; no other word starts with one.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xbaß-öø-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_WORDS = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
_BEYOND_LATIN = re.compile("[^\x00-\u017f]")
#: Words that a worker remembers the ids of, and the longest word among them.
MEMO, MEMO_CHARS = 1_000_000, 48


def words(text: str) -> list[str]:
    """The words of a text without special tokens: composed, in lower case, parted.

    No word spans white space. Each character is lowered by itself, so a final
    sigma is like any other.
    """
    if text.isascii() or not _BEYOND_LATIN.search(text):
        return _LATIN_WORDS.findall(text.lower())
    return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte.

    Bytes that print in Latin-1 stand for themselves, the others, in order, for
    the characters from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Vocabulary, merges and special tokens of a file; encodes one word or text at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.strings = [""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for string, i in ids.items():
            self.strings[i] = string
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for string, i in self.special.items():
            self.strings[i] = string
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        symbols = byte_symbols()
        self.first = [ids[s] for s in symbols]
        self.last = [ids[s + self.suffix] for s in symbols]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[left] << 32 | ids[right], (rank, ids[left + right]))

    def word(self, word: str) -> list[int]:
        """Ids of one word: merges in order of rank, then from the left.

        Candidate merges wait in a heap. The symbols form a doubly linked list,
        so a merge joins two neighbours in place; a candidate whose symbols have
        changed since is stale and skipped.
        """
        raw = word.encode("utf-8", "surrogatepass")
        first, merge = self.first, self.merges.get
        ids = [first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        # An entry is a rank and the place of its left symbol; equal ranks are the same pair.
        shift = n.bit_length()
        heap = [found[0] << shift | i for i in range(n - 1) if (found := merge(ids[i] << 32 | ids[i + 1]))]
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        place = (1 << shift) - 1
        while heap:
            entry = heapq.heappop(heap)
            i = entry & place
            j = after[i]
            if j >= n or not (found := merge(ids[i] << 32 | ids[j])) or found[0] != entry >> shift:
                continue
            joined = found[1]
            ids[i], ids[j] = joined, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merge(joined << 32 | ids[k]):
                    heapq.heappush(heap, found[0] << shift | i)
            if (h := before[i]) >= 0 and (found := merge(ids[h] << 32 | joined)):
                heapq.heappush(heap, found[0] << shift | h)
        return [i for i in ids if i >= 0]

    def text(self, text: str) -> list[int]:
        """Ids of a text: special tokens as they stand, the rest normalised, parted and merged."""
        out = []
        for part in self.split_special(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                for word in words(part):
                    out += self.word(word)
        return out

    def decode(self, ids) -> str:
        """Vocabulary strings of ``ids``, parted by spaces, as a file without a decoder asks for."""
        return " ".join(map(self.strings.__getitem__, ids))


class Memo(dict):
    """Ids (little-endian unsigned 32-bit) of words seen before, a bounded number of them.

    Two generations: when the young one is full it becomes the old one, whose
    words come back as they are met again. So frequent words stay, whatever
    number of rare ones passes. ``encode_text`` gives the ids of a text with
    special tokens, which are no words.
    """

    def __init__(self, encode_word, encode_text):
        self.encode_word, self.encode_text, self.old = encode_word, encode_text, {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = self.held(self.encode_word(word))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO // 2:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def held(self, ids: list[int]):
        return np.array(ids, "<u4").tobytes()

    def text(self, text: str | None) -> bytes:
        if text and "<|" in text:
            return self.held(self.encode_text(text))
        return b"".join(map(self.__getitem__, words(text or "")))


class Counts(Memo):
    """Number of ids of words seen before, as bounded."""

    held = staticmethod(len)

    def text(self, text: str | None) -> int:
        if text and "<|" in text:
            return len(self.encode_text(text))
        return sum(map(self.__getitem__, words(text or "")))


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Vocabulary, Memo]:
    vocabulary = Vocabulary(path)
    return vocabulary, Memo(vocabulary.word, vocabulary.text)


@lru_cache(maxsize=2)
def _counts(path: str) -> Counts:
    vocabulary = load(path)[0]
    return Counts(vocabulary.word, vocabulary.text)


def n_ids(text: Column, path: str) -> Column:
    """Number of ids of a text; 0 for NULL."""

    @F.pandas_udf("long")
    def counted(texts):
        counts = _counts(path)
        return type(texts)([counts.text(t) for t in texts], dtype="int64")

    # So that a filter on the number doesn't encode every text again.
    return counted.asNondeterministic()(text)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) for each row: ids as little-endian unsigned 32-bit integers, and their text.

    ``path`` is a vocabulary file that every executor has. NULL and empty texts
    have no ids and decode to ''. Texts are encoded whole; rows don't meet, so
    repeated rows and NULL ids are rows like others.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def coded(batches):
        vocabulary, memo = load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids = [memo.text(t) for t in texts[a:b]]
                decoded = [vocabulary.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[a:b], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"]
                )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(coded, f"id {kind}, ids binary, decoded string")
