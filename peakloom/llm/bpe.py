"""Byte-pair encoding of words on a contiguous rank array, and decoding.

A word starts as one part per byte. Two short lists hold the parts and, for
each inner boundary, the rank of merging across it. The smallest rank is found
by scanning, its boundary is deleted, and the two neighbouring ranks are looked
up again, until no boundary has a rank. The lists of a word fit a few cache
lines, so the scan beats a heap; only words of more than LONG bytes use a heap,
since rescanning would take quadratic time there.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.llm.common import TOGETHER, WordCache, encode_runs, list_array, texts_of

LONG = 400
#: Texts that are cut, encoded and digested together; few, since their decoded text is held as well.
FEW = 256
NO_RANK = 1 << 30
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + i)
    return [table[b] for b in range(256)]


def normalised(text: str) -> str:
    """Composed and lower-cased; characters are mapped one by one, so sigma gets no final form."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordBpe:
    """A tokenizer file of the kind: lower case, words with an end mark, byte-level pairs."""

    WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        symbols = byte_symbols()
        self.inner, self.final = [vocab[s] for s in symbols], [vocab[s + mark] for s in symbols]
        self.rank, self.merged = {}, []
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = n
            self.merged.append(vocab[a + b])
        marks = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.names = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], type=pa.string())
        self.numbers = pa.array([str(i) for i in range(len(self.names))], type=pa.string())
        self.words = WordCache(self._word, 50_000)
        self.runs = WordCache(self._run, 120_000)

    def merge(self, word: bytes) -> list[int]:
        """IDs of one word."""
        parts = [*map(self.inner.__getitem__, word[:-1]), self.final[word[-1]]]
        if len(parts) > LONG:
            return self.merge_long(parts)
        rank = self.rank.get
        ranks = [rank(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = self.merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 20 | parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = rank(parts[at] << 20 | parts[at + 1], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, with linked parts and a heap of boundaries."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or self.rank.get(parts[i] << 20 | parts[j]) != r:
                continue
            parts[i], gone[j], after[i] = self.merged[r], True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (s := self.rank.get(parts[left] << 20 | parts[right])) is not None:
                    heapq.heappush(heap, (s, left))
        return [p for p, g in zip(parts, gone, strict=True) if not g]

    def _word(self, word: str) -> bytes:
        return array("I", self.merge(word.encode())).tobytes()

    def _run(self, run: str) -> bytes:
        """IDs of a normalised text without spaces; letters alone, or before one mark, need no pattern."""
        if run.isalpha():
            return self._word(run)
        if run[-1:] in (".", ",") and run[:-1].isalpha():
            return self._word(run[:-1]) + self.words[run[-1]]
        return b"".join(map(self.words.__getitem__, self.WORDS.findall(run)))

    def encode(self, text: str) -> np.ndarray:
        """IDs of a text; the strings of special tokens become their IDs."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """IDs of each text. Words hold no space, so texts are cut at spaces and each distinct run is encoded once."""
        pieces = [self.cut.split(t) if self.cut is not None and self.cut.search(t) else [t] for t in texts]
        flat = [None if p in self.special else normalised(p) for parts in pieces for p in parts]
        ids = iter(encode_runs(flat, self.runs.__getitem__))
        found = []
        for parts in pieces:
            of_parts = [np.array([self.special[p]], "<u4") if p in self.special else x
                        for p, x in zip(parts, [next(ids) for _ in parts], strict=True)]
            found.append(of_parts[0] if len(of_parts) == 1 else np.concatenate(of_parts))
        return found

    def decode(self, ids) -> str:
        """The tokens of the IDs, joined by one space; IDs that the file lacks are skipped."""
        get = self.tokens.get
        return " ".join([t for t in map(get, ids) if t is not None])


    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """Text of each ID list, joined by Arrow; lists with a null or unknown ID one by one."""
        ids = lists.flatten()
        tokens = self.names.take(pc.if_else(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(self.names))), ids, None))
        if lists.null_count or tokens.null_count:
            return pa.array([self.decode(x) if x else "" for x in lists.to_pylist()], type=pa.string())
        sizes = pc.list_value_length(lists).to_numpy()
        return pc.binary_join(list_array(tokens, sizes), " ")


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One instance per worker process and file, so that known words serve later tasks too."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def bpe_encode(text: Column, path: str) -> Column:
    """IDs of each whole text as array<int>; empty for a null or empty text.

    Equal texts give equal lists; a text of any length is encoded whole.
    """
    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        coder, lists = loaded(path), []
        for begin in range(0, len(column), TOGETHER):
            lists += coder.encode_all(texts_of(column.slice(begin, TOGETHER)))
        flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
        return list_array(flat, [len(x) for x in lists])

    return encode(text)


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], type=pa.string())


def bpe_coded(text: Column, path: str, keep_ids: bool = True) -> Column:
    """`ids` (if kept), `n_tokens`, `ids_sha256` and `decoded_sha256` of each whole text, which is encoded once.

    The digests are those of the decimal IDs joined by one space and of the
    text that they decode to. A null text counts as the empty one, whose digests
    are those of the empty string. Equal texts give equal rows; a text of any
    length is encoded whole, in batches of FEW texts.
    """
    fields = ["ids array<int>"] * keep_ids + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]

    @F.arrow_udf(", ".join(fields))
    def coded(column: pa.Array) -> pa.Array:
        coder, parts = loaded(path), []
        for begin in range(0, max(1, len(column)), FEW):
            lists = coder.encode_all(texts_of(column.slice(begin, FEW)))
            flat, sizes = np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32), [len(x) for x in lists]
            numbers = pc.binary_join(list_array(coder.numbers.take(pa.array(flat)), sizes), " ")
            ids = list_array(flat, sizes)
            columns = [ids] * keep_ids + [pa.array(sizes, pa.int64()), _digests(numbers), _digests(coder.decode_all(ids))]
            parts.append(pa.StructArray.from_arrays(columns, [f.split(" ")[0] for f in fields]))
        pa.default_memory_pool().release_unused()  # workers live on between tasks and stages
        return pa.concat_arrays(parts)

    return coded(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """Text of each ID list; a null list is the empty text, null IDs are skipped."""
    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return loaded(path).decode_all(column)

    return decode(ids)
