"""Groups of texts that share at least 0.8 of their five-word shingles.

Similarity is the Jaccard coefficient of the sets of word shingles. Each text
has a SimHash fingerprint of its shingles, and fingerprints that anchors link
(`simhash.links`, at most four differing bits) are candidates. Texts of
similarity 0.8 differ in up to about 17 bits, further than anchors reach, so
minimum hashes find the others. Of each text 288 minimum hashes are taken. Six at a time they are a band, and texts
that agree in one of the 48 bands are candidates: two texts of similarity s
share no band with probability (1 - s**6)**48, which is below one in a million
at 0.8. Candidates are compared by one byte of every minimum hash, and those
with at least POSSIBLE of the bytes equal are possible links. At similarity 0.8
the share of equal bytes has mean 0.80 and deviation 0.024, so a true link is
below POSSIBLE with a probability under one in a million as well.

Only distinct texts are compared, and they are known by row numbers. Bands with
more than one text are gone through in sorted streams. Pairs of texts are never
rows: a band gives the links of a spanning forest of its possible links, and
the texts that bands and fingerprints connect are a cluster. The texts of a cluster are then
sent to one place, each once, where an inverted list of their shingles gives
the exact similarity of every pair that shares any; links of 0.8 or more are
again reported as a spanning forest. Crowded bands and large clusters are cut
into tiles, compared pair by pair of tiles in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm import simhash
from peakloom.llm.common import by_slices, list_array, staged
from peakloom.llm.components import components
from peakloom.operators.prefilter import may_match

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 48, 6
HASHES = BANDS * ROWS
#: Share of equal signature bytes from which a pair is confirmed on its texts.
POSSIBLE = 0.68
SEED = 42
#: Texts of a band, or of a cluster, that are compared in one task, and the bytes of text of a cluster.
CROWD = 2048
CROWD_BYTES = 16 << 20
#: Bands up to this size are compared all at once.
FEW = 8
_DRAW = np.random.default_rng(SEED)
_MASKS = _DRAW.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_FACTORS = _DRAW.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_MIX = _DRAW.integers(0, 1 << 63, (ROWS, BANDS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, a wordless one none."""
    return np.unique(_hashes(text.encode()))


def _hashes(data: bytes) -> np.ndarray:
    words = data.lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def minimums(data: bytes) -> np.ndarray:
    """The least value of each of HASHES hash functions over a text's shingles."""
    return _least(_hashes(data))


def _least(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, (1 << 32) - 1, dtype=np.uint32)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[i : i + 1024, None] ^ _MASKS) * _FACTORS).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A signed 64-bit key per text (row of minimums) and band; equal keys make two texts candidates."""
    rows = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(56), (len(least), BANDS)).copy()
    for r in range(ROWS):
        keys = (keys ^ rows[:, :, r]) * _MIX[r]
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def signature(text: Column) -> Column:
    """`keys` of the bands, `bytes`, one of every minimum hash, and the SimHash fingerprint `fp` of the shingles."""
    def signs(column: pa.Array) -> pa.Array:
        known: dict[bytes, tuple[np.ndarray, int]] = {}
        found = []
        for data in column.cast(pa.binary()).to_pylist():
            data = data or b""
            if data not in known:
                hashes = _hashes(data)
                known[data] = _least(hashes), simhash.majority(hashes)
            found.append(known[data])
        least = np.array([x for x, _ in found], dtype=np.uint32).reshape(-1, HASHES)
        keys = list_array(band_keys(least).ravel(), [BANDS] * len(least))
        low = pa.array([row.tobytes() for row in least.astype(np.uint8)], type=pa.binary())
        prints = pa.array([fp for _, fp in found], type=pa.int64())
        return pa.StructArray.from_arrays([keys, low, prints], ["keys", "bytes", "fp"])

    @F.arrow_udf("keys array<long>, bytes binary, fp long")
    def signed(column: pa.Array) -> pa.Array:
        return by_slices(column, signs)

    return signed(text)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sets of distinct hashes; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def text_id(text: Column) -> Column:
    """MD5 digest of a text; a null text is a text of its own."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b"").cast("binary"))


# --- comparing signatures


def _forest(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of links from the first text of each connected group of possible links to its others."""
    waiting, left, right = np.arange(len(signs)), [], []
    while len(waiting) > 1:
        root, front, waiting = waiting[0], waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            near = np.zeros(len(waiting), dtype=bool)
            for f in front:
                far = np.flatnonzero(~near)
                near[far] = (signs[waiting[far]] == signs[f]).mean(axis=1) >= POSSIBLE
            front, waiting = waiting[near], waiting[~near]
            left.append(np.full(len(front), root))
            right.append(front)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _possible(signs: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible links that connect complete runs of rows, from one edge to the next."""
    sizes = np.diff(edges)
    number = np.repeat(np.arange(len(sizes)), sizes)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = (sizes <= FEW)[number]
    for shift in range(1, min(FEW, len(number))):
        at = np.flatnonzero(few[shift:] & (number[shift:] == number[:-shift]))
        at = at[(signs[at] == signs[at + shift]).mean(axis=1) >= POSSIBLE]
        left.append(at)
        right.append(at + shift)
    for g in np.flatnonzero(sizes > FEW):
        a, b = _forest(signs[edges[g] : edges[g + 1]])
        left.append(a + edges[g])
        right.append(b + edges[g])
    return np.concatenate(left), np.concatenate(right)


def _streamed(batches: Iterator[pa.RecordBatch], compare) -> Iterator[pa.RecordBatch]:
    """Links of complete runs of equal (group, tile), the first two columns of sorted rows, by row number, the third.

    `compare` gets the last column of whole runs and their edges, and gives
    pairs of places. Holds one batch and one run.
    """
    keys, ids, values = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), []

    def links(edges: np.ndarray) -> pa.RecordBatch:
        a, b = compare(values[: edges[-1]], edges)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    for rows in batches:
        if not rows.num_rows:
            continue
        keys = np.concatenate([keys, np.stack([rows.column(i).to_numpy() for i in (0, 1)], axis=1)])
        ids = np.concatenate([ids, rows.column(2).to_numpy()])
        values += rows.column(3).cast(pa.binary()).to_pylist()
        edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        if len(edges) > 1:
            yield links(edges)
            keys, ids, values = keys[edges[-1] :], ids[edges[-1] :], values[edges[-1] :]
    if len(keys):
        yield links(np.array([0, len(keys)]))


def _tiled(rows: DataFrame, tiles: Column, *columns: str) -> DataFrame:
    """Rows (`group`, `rid`, ...) at every pair of tiles of their group that their own tile is in, sorted for `_streamed`."""
    own = F.pmod(F.xxhash64("rid"), tiles)
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), tiles - 1), lambda j: F.greatest(own, j) * tiles + F.least(own, j))
    placed = rows.select("group", F.explode(pair).alias("tile"), "rid", *columns)
    return placed.repartition("group", "tile").sortWithinPartitions("group", "tile", "rid")


def _tiles(size: Column, most: int) -> Column:
    return F.when(size > most, F.ceil(size / (most // 2)).cast("long")).otherwise(F.lit(1).cast("long"))


def _possible_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def compare(signs: list[bytes], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _possible(np.frombuffer(b"".join(signs), np.uint8).reshape(-1, HASHES), edges)

    return _streamed(batches, compare)


def _printed_links(marked: DataFrame) -> DataFrame:
    """Links `a, b` from the first text of every group of linked fingerprints to its others."""
    prints = marked.filter(F.col("fp").isNotNull()).select("rid", "fp")
    roots = components(simhash.links(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    rooted = staged(prints.join(roots, "fp", "left").select("rid", F.coalesce("root", "fp").alias("root")), "copies-prints")
    firsts = rooted.groupBy("root").agg(F.min("rid").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return rooted.join(firsts, "root").filter("rid > a").select("a", F.col("rid").alias("b"))


def _clusters(marked: DataFrame, crowd: int) -> DataFrame:
    """`rid, group` of every text with a possible link: the same group for all that possible links connect."""
    posted = marked.select(F.explode("keys").alias("group"), "rid")
    shared = posted.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    bands = posted.join(shared.select("group", _tiles(F.col("n"), crowd).alias("_tiles")), "group")
    signed = staged(bands.join(marked.select("rid", "bytes"), "rid"), "copies-bands")
    links = _tiled(signed, F.col("_tiles"), "bytes").mapInArrow(_possible_links, "a long, b long")
    roots = staged(components(links.unionAll(_printed_links(marked))), "copies-clusters")
    firsts = roots.select(F.col("root").alias("rid"), F.col("root").alias("group")).distinct()
    return roots.select(F.col("node").alias("rid"), F.col("root").alias("group")).unionAll(firsts)


# --- confirming on whole texts


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect all sets of similarity SIMILAR or more, directly or on a path.

    One inverted list of the members of all sets counts, for a set, the
    members that it shares with every later one.
    """
    sizes = np.array([len(x) for x in sets])
    member, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(code, kind="stable")
    listed, ends = owner[order], np.cumsum(np.bincount(code, minlength=len(member)))
    starts = np.concatenate([[0], ends[:-1]])
    group, left, right = np.arange(len(sets)), [], []
    first = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(sets) - 1):
        own = code[first[i] : first[i + 1]]
        lengths = ends[own] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(listed[at], minlength=len(sets))[i + 1 :]
        either = sizes[i] + sizes[i + 1 :] - both
        alike = np.where(either > 0, both / np.maximum(either, 1) >= SIMILAR, True)
        for j in np.flatnonzero(alike) + i + 1:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                left.append(i)
                right.append(j)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _confirmed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def compare(texts: list[bytes], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            i, j = similar([np.unique(_hashes(t)) for t in texts[a:b]])
            left.append(i + a)
            right.append(j + a)
        return np.concatenate(left), np.concatenate(right)

    return _streamed(batches, compare)


def _confirmed(clusters: DataFrame, marked: DataFrame, docs: DataFrame, text: str, crowd: int) -> DataFrame:
    """Links `a, b` that connect the texts of similarity SIMILAR or more in each cluster.

    Texts are read where they stand, and only those of clusters are moved.
    """
    wanted = staged(marked.select("rid", "tid").join(clusters, "rid"), "copies-wanted")
    read = docs.filter(F.col(text).isNotNull()).select(text_id(F.col(text)).alias("tid"), F.col(text).alias("text"))
    near = may_match(read, wanted.select("tid"), ["tid"]).join(wanted, "tid").select("rid", "group", "text")
    texts = staged(near.dropDuplicates(["rid"]), "copies-texts")
    sizes = texts.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    tiles = sizes.select("group", F.greatest(_tiles(F.col("n"), crowd), _tiles(F.col("size"), CROWD_BYTES)).alias("_tiles"))
    rows = _tiled(texts.join(tiles, "group"), F.col("_tiles"), "text")
    return staged(rows.mapInArrow(_confirmed_links, "a long, b long"), "copies-links")


def near_copies(docs: DataFrame, text: str = "text", crowd: int = CROWD) -> DataFrame:
    """`tid, root` for every distinct text: the same root for all texts that links connect.

    Null texts are one text and alike to nothing else; all wordless texts are
    alike. Very long texts are shingled whole. Repeated rows count once. Only
    the text column is read; an empty table gives no rows.
    """
    signed = docs.select(text_id(F.col(text)).alias("tid"), F.when(F.col(text).isNotNull(), signature(F.col(text))).alias("s"))
    distinct = signed.select("tid", "s.keys", "s.bytes", "s.fp").dropDuplicates(["tid"])
    marked = staged(distinct.withColumn("rid", F.monotonically_increasing_id()), "copies-rows")
    links = _confirmed(_clusters(marked, crowd), marked, docs, text, crowd)
    roots = components(links).withColumnRenamed("node", "rid")
    return marked.select("tid", "rid").join(roots, "rid", "left").select("tid", F.coalesce("root", "rid").alias("root"))
