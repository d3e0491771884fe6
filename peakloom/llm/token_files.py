"""Token IDs in Simple-8b coded files.

A document's IDs are cut into blocks of BLOCK IDs. Each block is packed
greedily into 64-bit words: the upper four bits of a word are a selector that
says how many IDs of how many bits its other sixty bits hold. Selector 0 is an
escape: the next word holds one ID that needs more than sixty bits. A payload
is, in little-endian order,

    uint32 number of IDs, uint32 number of blocks,
    uint32 first word of each block, uint64 words

so blocks can be decoded alone, and many of them at once by vector operations.

A token folder holds `parts` (doc_id, n_tokens, part, before, payload; in
ascending doc_id order, part by part) and `index` (part, start), the number of
IDs before each part. Both are written by Spark's committing Parquet writer.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.llm.bpe import byte_symbols
from peakloom.llm.common import TOGETHER, WordCache, category_ranges, list_array, texts_of

BLOCK = 512
#: Fixed values: (IDs per word, bits per ID) of selectors 2 to 15.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
            (2, 30), (1, 60))
FIRST_SELECTOR = 2
ESCAPE = 0
PARTS = "doc_id long, n_tokens long, part int, before long, payload binary"


#: Bits that each 16-bit value needs.
SHORT_BITS = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs, at least one."""
    if not len(values) or values.max() < len(SHORT_BITS):
        return SHORT_BITS[values]
    bits = np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)
    large = values >= np.uint64(1 << 53)  # a double may round these up
    if large.any():
        bits[large] = 32 + np.frexp((values[large] >> np.uint64(32)).astype(np.float64))[1]
    return bits


def _choices(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For every position the selector that packs most IDs from there; `left` IDs remain in its block."""
    n = len(bits)
    chosen = np.zeros(n, dtype=np.uint8)  # the escape
    running, length = bits.copy(), 1
    room = np.minimum(left, PACKINGS[0][0]).astype(np.uint8)
    for at in range(len(PACKINGS) - 1, -1, -1):
        count, width = PACKINGS[at]
        while length < count:  # running maximum over `count` values, grown by doubling where it can
            step = min(length, count - length)
            if n > step:
                running[: n - step] = np.maximum(running[: n - step], running[step:])
            length += step
        np.copyto(chosen, at + FIRST_SELECTOR, where=(running <= width) & (room >= count), casting="unsafe")
    return chosen


def encode(lists: list[np.ndarray]) -> list[bytes]:
    """One payload per list of unsigned IDs; all blocks of all lists are packed side by side."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    values = np.concatenate([np.asarray(x, dtype=np.uint64) for x in lists]) if len(lists) else np.zeros(0, np.uint64)
    blocks = -(-sizes // BLOCK)
    first = np.repeat(np.cumsum(sizes) - sizes, blocks)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first + number * BLOCK
    end = np.minimum(start + BLOCK, np.repeat(np.cumsum(sizes), blocks))
    left = np.repeat(end, end - start) - np.arange(len(values))
    chosen = _choices(bit_lengths(values), left)
    counts = np.array([1, 0, *[c for c, _ in PACKINGS]])[chosen]
    # walk all blocks at once: word k of every block that has one
    begins, at, stop = np.zeros(len(values), dtype=bool), start, end
    while len(at):
        begins[at] = True
        at = at + counts[at]
        more = at < stop
        at, stop = at[more], stop[more]
    position = np.flatnonzero(begins)
    selector = chosen[position]
    width = 1 + (selector == ESCAPE)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), dtype=np.uint64)
    for s in np.unique(selector):
        at = selector == s
        if s == ESCAPE:
            words[place[at] + 1] = values[position[at]]
            continue
        count, bits = PACKINGS[s - FIRST_SELECTOR]
        packed, first_id = np.full(int(at.sum()), int(s) << 60, dtype=np.uint64), position[at]
        for i in range(count):
            packed |= values[first_id + i] << np.uint64(i * bits)
        words[place[at]] = packed
    block_start = place[np.searchsorted(position, start)]
    data, out = words.astype("<u8").tobytes(), []
    upto = np.concatenate([[0], np.cumsum(blocks)])
    ends = np.concatenate([block_start, [len(words)]])
    for i, n in enumerate(sizes):
        a, b = upto[i], upto[i + 1]
        base, stop = int(ends[a]), int(ends[b])
        head = np.concatenate([[n, b - a], block_start[a:b] - base]).astype("<u4")
        out.append(head.tobytes() + data[8 * base : 8 * stop])
    return out


def decode(payloads: list[bytes]) -> list[np.ndarray]:
    """The IDs of each payload, as uint64; all words of all payloads are unpacked side by side."""
    if not payloads:
        return []
    sizes, pieces, starts, base = [], [], [], 0
    for p in payloads:
        n, blocks = np.frombuffer(p, "<u4", 2)
        words = np.frombuffer(p, "<u8", offset=8 + 4 * int(blocks)) if n else np.zeros(0, np.uint64)
        sizes.append(int(n))
        pieces.append(words)
        starts.append(np.frombuffer(p, "<u4", int(blocks), 8).astype(np.int64) + base)
        base += len(words)
    words = np.concatenate(pieces)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # a raw word follows each escape; blocks begin with a selector, so escapes are followed from there
    raw = np.zeros(len(words) + 1, dtype=bool)
    if (selector == ESCAPE).any():
        at = np.concatenate(starts)
        stop = np.concatenate([at[1:], [len(words)]])
        while len(at):
            escaped = selector[at] == ESCAPE
            raw[at[escaped] + 1] = True
            at = at + 1 + escaped
            at, stop = at[at < stop], stop[at < stop]
    raw = raw[:-1]
    counts = np.array([0, 0, *[c for c, _ in PACKINGS]])[selector]
    counts[raw] = 1
    place = np.cumsum(counts) - counts
    values = np.zeros(int(counts.sum()), dtype=np.uint64)
    values[place[raw]] = words[raw]
    selector[raw] = -1
    for s, (count, bits) in enumerate(PACKINGS, FIRST_SELECTOR):
        at = np.flatnonzero(selector == s)
        if len(at):
            shift = (np.arange(count) * bits).astype(np.uint64)
            mask = np.uint64((1 << bits) - 1)
            values[place[at][:, None] + np.arange(count)] = (words[at][:, None] >> shift) & mask
    return np.split(values, np.cumsum(sizes)[:-1])


class Tokenizer:
    """A byte-level tokenizer file, with the IDs of words met before kept at hand.

    Texts are cut into words by the published pattern of byte-level BPE; the
    library encodes each new word. Texts with characters outside long-settled
    ranges go to the library whole, since Unicode versions may differ there,
    and so do texts that hold a special token.
    """

    SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    LETTER, NUMBER = category_ranges("L"), category_ranges("N")
    PIECES = re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
        rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )
    UNSETTLED = re.compile(
        r"[^\x00-\u036f\u0400-\u0523\u1e00-\u1eff\u2000-\u2064\u20a0-\u20b5\u2100-\u214d\u2190-\u21ff"
        r"\u3000-\u303f\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]"
    )

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs one task per core
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.symbols = dict(enumerate(byte_symbols()))
        self.words = WordCache(self._word, 400_000)

    def _word(self, word: str) -> bytes:
        """IDs of one word by the library's model, which works on one symbol per byte."""
        symbols = word.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.library.model.tokenize(symbols)]).tobytes()

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if (not text.isascii() and self.UNSETTLED.search(text)) or any(t in text for t in self.special):
            return np.frombuffer(self._ids(text), "<u4")
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.PIECES.findall(text))), "<u4")


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per worker process and file, so that known words serve later tasks too."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode every text, append `end_id`, and write the token folder.

    Rows are ordered by key (null first), then text; a null text is the empty
    one and yields the end ID alone. Repeated rows are all written, next to
    each other. The texts move once, before they are encoded, and each part is
    sorted and encoded in its own task. An empty table gives an empty folder.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
    )

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, number, before = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(begin, TOGETHER)
                ids = [np.append(x, np.uint32(end_id)) for x in map(tok.encode, texts_of(rows.column(1)))]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(sizes), pa.array(np.full(len(ids), number, np.int32)),
                     pa.array(before + np.cumsum(sizes) - sizes), pa.array(encode(ids), type=pa.binary())],
                    ["doc_id", "n_tokens", "part", "before", "payload"],
                )
                before += int(sizes.sum())

    ordered.mapInArrow(part, PARTS).write.parquet(f"{folder}/parts")
    totals = spark.read.schema(PARTS).parquet(f"{folder}/parts").groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    totals.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start")).coalesce(1).write.parquet(
        f"{folder}/index"
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id, start, n_tokens, payload` of a token folder; `start` counts all IDs before the document.

    The index has one row per part and is broadcast.
    """
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts")
    index = spark.read.schema("part int, start long").parquet(f"{folder}/index")
    return parts.join(F.broadcast(index.withColumnRenamed("start", "_start")), "part").select(
        "doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "payload"
    )


def token_ids(payload: Column) -> Column:
    """The decoded IDs of a payload column."""
    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        lists = decode(column.to_pylist())
        flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
        return list_array(flat, [len(x) for x in lists])

    return ids(payload)


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of IDs as little-endian unsigned 32-bit integers."""
    @F.arrow_udf("long")
    def crc(column: pa.Array) -> pa.Array:
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype("<u4")
        return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)], pa.int64())

    return crc(ids)


def payload_digest(payload: Column) -> Column:
    """`n_tokens` and `ids_crc32` of the IDs that a payload decodes to; the IDs stay in the Python worker."""
    @F.arrow_udf("struct<n_tokens: long, ids_crc32: long>")
    def digest(column: pa.Array) -> pa.Array:
        lists = [x.astype("<u4") for x in decode(column.to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([len(x) for x in lists], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in lists], pa.int64())],
            ["n_tokens", "ids_crc32"],
        )

    return digest(payload)
