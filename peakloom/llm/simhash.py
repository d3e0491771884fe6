"""Near-duplicate groups by SimHash fingerprints and anchor points.

Fingerprints of 64 bits link at four or fewer differing bits. Cut in halves,
two linked fingerprints differ in at most two bits of one half, so some word
lies within one bit of both of their halves. Anchors are the words of the
perfect Hamming code on 31 bits of a half: every word is within the covering
radius, one, of exactly one anchor. The anchor of the word between the halves
is thus within the covering radius plus one of both: if every half goes to all
anchors that near (one or sixteen of them), linked fingerprints meet at an
anchor. There they are compared in full.

Only distinct fingerprints are compared, so copies cost nothing. Members of an
anchor report the links of a spanning forest, not all pairs. An anchor with
more than CROWD members is cut into tiles, compared pair by pair of tiles in
separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import staged, texts_of
from peakloom.llm.components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
CROWD = 4096
FEW = 64
CODE_BITS = 31
FOUND = "a long, b long, bucket long"


def fingerprint(text: str) -> int:
    """SimHash of a text's word shingles as a signed 64-bit integer; zero without words."""
    words = text.encode().lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: 1 - SHINGLE or None].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit integer; zero without hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: Column) -> Column:
    """Fingerprint of each whole text as a long; zero for a null text or one without words."""
    @F.arrow_udf("long")
    def hashed(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t) for t in texts_of(column)], type=pa.int64())

    return hashed(text)


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def near_anchors(half: Column) -> Column:
    """All code words within two bits of a 31-bit word.

    Bit positions count from one. The syndrome is the exclusive-or of the
    positions of set bits. A code word has syndrome zero and is its only near
    anchor. Otherwise flipping the bit that the syndrome names, or any two bits
    whose positions combine to it, gives a code word.
    """
    syndrome = F.lit(0)
    for bit in range(5):
        mask = sum(1 << (p - 1) for p in range(1, CODE_BITS + 1) if p >> bit & 1)
        odd = F.bit_count(half.bitwiseAND(F.lit(mask))) % 2
        syndrome = syndrome + odd * (1 << bit)

    def flip(word: Column, position: Column) -> Column:
        return word.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), position - 1))

    one = F.array(flip(half, syndrome))
    partners = F.filter(
        F.array(*[F.lit(p) for p in range(1, CODE_BITS + 1)]),
        lambda p: (p < p.bitwiseXOR(syndrome)) & (p != syndrome),
    )
    two = F.transform(partners, lambda p: flip(flip(half, p), p.bitwiseXOR(syndrome)))
    return F.when(syndrome == 0, F.array(half)).otherwise(F.concat(one, two))


def buckets(fingerprints: DataFrame) -> DataFrame:
    """`bucket, fp`: each fingerprint at all near anchors of both halves."""
    low = F.col("fp").bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    high = F.shiftrightunsigned("fp", 64 - CODE_BITS)
    at = F.concat(
        near_anchors(low), F.transform(near_anchors(high), lambda x: x.bitwiseOR(F.lit(1 << CODE_BITS)))
    )
    return fingerprints.select("fp", at.alias("at")).select(F.explode_outer("at").alias("bucket"), "fp")


def _forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the first member of each component of one bucket to its other members."""
    waiting, left, right = members, [], []
    while len(waiting) > 1:
        root, front, waiting = waiting[0], waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            near = np.zeros(len(waiting), dtype=bool)
            for i in range(0, len(front), 256):
                apart = np.bitwise_count(front[i : i + 256, None] ^ waiting)
                near |= (apart <= MAX_BITS).any(axis=0)
            front, waiting = waiting[near], waiting[~near]
            left.append(np.full(len(front), root))
            right.append(front)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside complete, sorted buckets: small ones all at once by shifting, others one by one."""
    edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
    sizes = np.diff(edges)
    number = np.repeat(np.arange(len(sizes)), sizes)
    few = (sizes <= FEW)[number]
    group, fp = number[few], fps[few]
    left, right = [], []
    for shift in range(1, FEW):
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        near = same & (np.bitwise_count(fp[shift:] ^ fp[:-shift]) <= MAX_BITS)
        left.append(fp[:-shift][near])
        right.append(fp[shift:][near])
    for g in np.flatnonzero(sizes > FEW):
        a, b = _forest(fps[edges[g] : edges[g + 1]])
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(crowd: int | None):
    """A mapper over rows (bucket, tile, fp) that are sorted by bucket and tile.

    Gives links; the members of buckets with more than `crowd` rows come back
    uncompared, with their bucket. Holds one Arrow batch and one bucket.
    """
    def batch(a, b, bucket=None):
        a, b = (pa.array(x.view(np.int64)) for x in (a, b))
        column = pa.nulls(len(a), pa.int64()) if bucket is None else pa.array(bucket)
        return pa.RecordBatch.from_arrays([a, b, column], ["a", "b", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        crowded = None
        for rows in batches:
            new = np.stack([rows.column(0).to_numpy(), rows.column(1).to_numpy()], axis=1)
            keys = np.concatenate([keys, new])
            fps = np.concatenate([fps, rows.column(2).to_numpy().view(np.uint64)])
            if crowded is not None:  # go on handing back a bucket that began earlier
                n = int((keys == crowded).all(axis=1).sum())
                if n:
                    yield batch(fps[:n], fps[:n], keys[:n, 0])
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                crowded = None
            if not len(keys):
                continue
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
            sizes = np.diff(edges)
            last = edges[-2]
            if crowd is not None:
                over = np.repeat(sizes > crowd, sizes)
                if over.any():
                    yield batch(fps[over], fps[over], keys[over, 0])
                if sizes[-1] > crowd:
                    crowded, last = keys[-1].copy(), len(keys)
                done = ~over[:last]
            else:
                done = np.ones(last, dtype=bool)
            yield batch(*_links(keys[:last][done], fps[:last][done]))
            keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield batch(*_links(keys, fps))

    return run


def links(fingerprints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """`a, b`: links that connect all distinct fingerprints (`fp`) within MAX_BITS of each other, directly or on a path."""
    rows = buckets(fingerprints).select("bucket", F.lit(0).cast("long").alias("tile"), "fp")
    sorted_rows = rows.repartition("bucket").sortWithinPartitions("bucket", "fp")
    found = staged(sorted_rows.mapInArrow(_compare(crowd), FOUND), "simhash-links")
    crowded = found.filter(F.col("bucket").isNotNull()).select("bucket", F.col("a").alias("fp"))
    tiles = F.ceil(F.col("n") / (crowd // 2)).cast("int")
    sizes = crowded.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", tiles.alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.greatest(own, j) * F.col("tiles") + F.least(own, j)
    )
    tiled = crowded.join(sizes, "bucket").select("bucket", F.explode_outer(pair).alias("tile"), "fp")
    rest = (
        tiled.select("bucket", F.col("tile").cast("long").alias("tile"), "fp")
        .repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "fp").mapInArrow(_compare(None), FOUND)
    )
    return found.filter(F.col("bucket").isNull()).select("a", "b").unionAll(rest.select("a", "b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """`key, fp, component_id` for every row: the smallest key of the texts linked to it, itself included.

    A null or wordless text has fingerprint zero and links like any other.
    Repeated rows are all returned. A null key is never the smallest, unless
    its group has no other. An empty table gives no rows. Only key and text
    are read, and only fingerprints move.
    """
    marked = staged(docs.select(F.col(key), simhash(F.col(text)).alias("fp")), "simhash-rows")
    distinct = staged(marked.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), crowd))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = staged(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-groups")
    return marked.join(groups, "fp").select(key, "fp", "component_id")
