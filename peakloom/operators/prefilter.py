"""Rows of a large table that may match a smaller key list, found before any shuffle.

The keys of the small side are hashed into a Bloom bitmap: each key sets one
bit per seed, at a position that its hash names. The bitmap is built in pieces
of 4 KB with Spark's bitmap aggregate, and the pieces travel by broadcast after
a check of their total size. A row passes if all its bits are set; rows with a
listed key always do, others rarely. An exact join follows, so the result never
depends on the bitmap. Key lists too long for the size allowed are not used as
a filter, and the join alone does the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one piece, fixed by Spark's bitmap aggregate.
PIECE = 32_768
BITS_A_KEY = 24
SEEDS = (17, 71)
#: Largest bitmap that is broadcast, in bytes: 5.6 million keys.
MAX_BYTES = 16 << 20


def bitmap_bits(keys: int, max_bytes: int = MAX_BYTES) -> int | None:
    """Bits for so many keys, a multiple of PIECE; None if they exceed `max_bytes`."""
    bits = max(1, -(-keys * BITS_A_KEY // PIECE)) * PIECE
    return bits if bits <= 8 * max_bytes else None


def _position(key: list[Column], seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(bits).cast("long"))


def key_bitmap(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """`piece, bitmap` of the keys; pieces without a key are left out."""
    positions = F.array(*[_position([F.col(c) for c in columns], s, bits) for s in SEEDS])
    placed = keys.select(F.explode(positions).alias("_p"))
    return placed.groupBy(F.expr(f"_p div {PIECE}").alias("piece")).agg(
        F.bitmap_construct_agg(F.col("_p") % PIECE).alias("bitmap"))


def _is_set(bitmap: Column, position: Column) -> Column:
    at = position % PIECE
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def flagged(large: DataFrame, keys: DataFrame, columns: list[str], name: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add the boolean column `name`: whether a row's key may be among the distinct `keys`; all true if the bitmap would be too large.

    `keys` is counted and read once for the bitmap, so it should be a written
    table. A null in a key column counts like any other value.
    """
    bits = bitmap_bits(keys.count(), max_bytes)
    if bits is None:
        return large.withColumn(name, F.lit(True))
    pieces = key_bitmap(keys, columns, bits)
    rows, every = large, F.lit(True)
    for i, seed in enumerate(SEEDS):
        at, piece, bitmap = (f"{name}_{part}{i}" for part in ("at", "piece", "bitmap"))
        rows = rows.withColumn(at, _position([F.col(c) for c in columns], seed, bits))
        found = pieces.select(F.col("piece").alias(piece), F.col("bitmap").alias(bitmap))
        rows = rows.join(F.broadcast(found), F.call_function("div", F.col(at), F.lit(PIECE)) == F.col(piece), "left_outer")
        every = every & _is_set(F.col(bitmap), F.col(at))
    columns_kept = [F.col("`" + c.replace("`", "``") + "`") for c in large.columns]
    return rows.select(*columns_kept, every.alias(name))


def may_match(large: DataFrame, keys: DataFrame, columns: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of `large` whose key may be among the distinct `keys`, with the columns as they were."""
    return flagged(large, keys, columns, "__may_match", max_bytes).filter("__may_match").drop("__may_match")


def keep_matching(large: DataFrame, keys: DataFrame, columns: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of `large` with a listed key: those that the bitmap lets through, then an exact semi join."""
    return may_match(large, keys, columns, max_bytes).join(keys, columns, "left_semi").select(*large.columns)
