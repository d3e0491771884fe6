"""Mixing of sources to target weights by Sainte-Lague apportionment of blocks.

Documents of a source are laid end to end in a seeded order and cut into blocks
of (within one word) equal length. Blocks are seats: source and seat i bid the
quotient votes / (2 i + 1), where a source's votes are its target in blocks, and
the highest quotients win. The order in which seats are won fills one shard of
the mix after the other, so each shard has integer quotas per source that add
up to those of the whole. The blocks themselves are drawn by a seeded
permutation of the source's blocks, which is walked through again from its
start when it is used up. DataFrame functions only; what is gathered on the
driver are a few counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from peakloom.functions.binding import let
from peakloom.llm.common import staged
from peakloom.operators.ranking import totals_before

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 32
#: More blocks than this are avoided by longer ones, so that their numbers stay below the factor of the permutation.
MAX_BLOCKS = 1 << 30
SHARDS = 4
SEED = 42
#: A prime above every number of blocks, so it has no divisor in common with one.
PRIME = 2_147_483_659
#: Source tables up to this many rows are broadcast.
BROADCAST_SOURCES = 50_000
#: Seats that may be ranked one by one after the search for a divisor.
CLOSE = 100_000
SPREADS = (0.7, 0.2, 0.05, 0.01, 2e-3, 4e-4, 8e-5, 1.6e-5)
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """`source, source_size, rank`: sources with their words, ranked from 0 by code point, null last.

    Sorted in parallel; the counts of the sorted partitions give each its first rank.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ids = staged(totals.orderBy(F.asc_nulls_last("source")).withColumn("_id", F.monotonically_increasing_id()), "mix-sources")
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ids.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return ids.withColumn("_part", part).join(F.broadcast(firsts), "_part").select(
        "source", "source_size", (F.col("_first") + at).alias("rank"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Add `weight` and `target`, a source's share of all words.

    Words are shared by weight; sources that would get more than `repeats`
    times their own size stop there, and the rest is shared among the others,
    until none is above. Every round stops at least one more source.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    weighed = staged(sources.withColumn("weight", weight).withColumn("_cap", repeats * F.col("source_size")), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    left, shared = total, None
    while True:  # left words for `shared` weight: a source is stopped if cap * shared <= left * weight
        stopped = F.lit(False) if shared is None else F.col("_cap").cast("decimal(38,0)") * shared <= F.col("weight") * F.lit(left)
        sums = weighed.agg(
            F.coalesce(F.sum(F.when(stopped, F.col("_cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if (total - sums["capped"], sums["weight"]) == (left, shared) or not sums["weight"]:
            break
        left, shared = total - sums["capped"], sums["weight"]
    share = F.lit(left).cast("double") * F.col("weight") / F.lit(max(shared or 1, 1)).cast("double")
    target = F.when(stopped, F.col("_cap").cast("double")).otherwise(share)
    return weighed.select("source", "source_size", "rank", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _seats(quotient: Column) -> Column:
    """Seats of a source whose quotients reach `quotient`, at most all its passes."""
    near = F.floor(F.col("votes") / (2 * quotient) + 0.5)
    more = (F.col("votes") / (2 * near + 1) >= quotient).cast("long")
    less = ((near > 0) & (F.col("votes") / (2 * near - 1) < quotient)).cast("long")
    return F.least(near + more - less, F.col("most"))


def quotas(targets: DataFrame, block_words: int = BLOCK_WORDS, repeats: int = MAX_REPEATS, shards: int = SHARDS) -> DataFrame:
    """Add `blocks` (of one pass over a source) and `quota`: blocks of the source in the first 1, 2, ... `shards` shards.

    All shards together have as many blocks as there are votes; equal quotients
    go to the source of the smaller rank.
    """
    size = F.col("source_size")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    length = max(block_words, -(-total // MAX_BLOCKS))
    blocks = F.when(size > 0, F.greatest(F.lit(1).cast("long"), F.floor(size / F.lit(length).cast("double") + 0.5))).otherwise(0)
    votes = F.when(size > 0, F.col("target") * F.col("blocks") / size).otherwise(0.0)
    bidding = staged(
        targets.withColumn("blocks", blocks.cast("long")).withColumn("votes", votes)
        .withColumn("most", repeats * F.col("blocks")), "mix-votes")
    # whole 1024ths, so that the sum does not depend on its order
    parts = bidding.agg(F.sum(F.floor(F.col("votes") * 1024))).first()[0] or 0
    seats = (parts + 512) // 1024
    houses = [seats * (s + 1) // shards for s in range(shards)]
    bounds = bidding.filter("votes > 0").agg(
        F.max("votes").alias("top"), F.min("votes").alias("low"), F.sum("most").alias("seats"), F.max("most").alias("deep")).first()
    between = {f"_q{s}": _between(bidding, house, bounds, parts / 1024) for s, house in enumerate(houses)}
    searched = staged(bidding.withColumns(between), "mix-quotients")
    found = searched
    for s, house in enumerate(houses):
        found = found.join(_close_winners(searched, s, house), "rank", "left")
    quota = F.array(*[F.col(f"_q{s}.low") + F.coalesce(f"_won{s}", F.lit(0)) for s in range(shards)])
    return found.select(*bidding.columns, quota.alias("quota"))


def _between(bidding: DataFrame, house: int, bounds: Row, votes: float) -> Column:
    """Seats that a source wins surely and possibly (`low`, `high`) in a house of so many seats.

    A quotient is sought that about `house` seats reach, by counting the seats
    for several quotients at a time.
    """
    if not house:
        return F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    few, least = 2 * bounds["top"] + 1, 0
    many, most = bounds["low"] / (2 * bounds["deep"] + 2), bounds["seats"]
    guess = votes / (2 * house)
    steps = [guess * (1 + x) for x in SPREADS] + [guess] + [guess * (1 - x) for x in SPREADS]
    while True:  # quotients above `few` win, those below `many` do not
        tried = sorted({x for x in steps if many < x < few})
        if not tried:
            break
        sums = bidding.agg(*[F.sum(_seats(F.lit(x))).alias(f"s{i}") for i, x in enumerate(tried)]).first()
        for x, n in zip(tried, sums, strict=True):
            if n >= house:
                many, most = max(many, x), n if x >= many else most
            if n <= house:
                few, least = (x, n) if x <= few else (few, least)
        if most - least <= CLOSE:
            break
        span = few / many
        steps = [many * span ** (i / 17) for i in range(1, 17)]
        if span < 1 + 1e-13:
            break
    low = _seats(F.lit(few)) if least else F.lit(0).cast("long")
    return F.struct(low.alias("low"), F.greatest(low, _seats(F.lit(many))).alias("high"))


def _close_winners(searched: DataFrame, s: int, house: int) -> DataFrame:
    """`rank, _won`: the seats beyond the sure ones of shard `s`, won by the highest of the close quotients."""
    q = F.col(f"_q{s}")
    sure = searched.agg(F.sum(q["low"])).first()[0] or 0
    close = searched.filter(q["high"] > q["low"]).select(
        "rank", "votes", F.explode(F.sequence(q["low"], q["high"] - 1)).alias("_seat"))
    bids = close.withColumn("_bid", F.col("votes") / (2 * F.col("_seat") + 1))
    winners = bids.orderBy(F.desc("_bid"), "rank").limit(max(0, house - sure))
    return winners.groupBy("rank").agg(F.count("*").alias(f"_won{s}"))


# --- blocks of a document


def _start(block: Column) -> Column:
    """First word of a block: the first `source_size % blocks` blocks are one word longer."""
    return block * F.expr("source_size div blocks") + F.least(block, F.col("source_size") % F.col("blocks"))


def _block(word: Column) -> Column:
    short, longer = F.expr("source_size div blocks"), F.col("source_size") % F.col("blocks")
    ahead = longer * (short + 1)
    return F.floor(F.when(word < ahead, _whole(word, short + 1)).otherwise(longer + _whole(word - ahead, F.greatest(short, F.lit(1)))))


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _multiplier() -> Column:
    """Factor of a source's permutation, below its number of blocks and without a common divisor."""
    return F.lit(PRIME) % F.col("blocks")


def _place(block: Column, seed: int) -> Column:
    """Place of a block in the seeded permutation of its source's blocks."""
    shift = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rank").cast("string"))), 1, 8), 16, 10)
    return (block * F.col("_factor") + shift.cast("long") % F.col("blocks")) % F.col("blocks")


def mixed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """`doc_id, size, source_size, target, taken, by_shard` for every row of `docs`.

    `taken` counts the words of the row in the mix, with repeats, at most
    `repeats` times its size; `by_shard` splits them over the shards. The words
    of a source are its target to within about half a block, those of a source
    shorter than a block are too. Null and empty texts have no words and give
    none. A null source is a source like any other, ranked last. Rows of equal
    key are told apart by their text; which of several equal rows is taken
    more often is not defined, the rows as a whole are. An empty table gives no
    rows. Only key, text and source are read.
    """
    order = F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    sizes = staged(
        docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words_of(F.col(text)).alias("size"),
                    order.alias("_order")), "mix-sizes")
    plan = quotas(with_targets(numbered_sources(sizes), weights, repeats), block_words, repeats, shards)
    plan = staged(plan.drop("votes", "most", "weight"), "mix-plan")
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    placed = totals_before(
        sizes.withColumn("_bucket", F.substring("_order", 1, 3)), "_bucket", [F.col("_order"), F.col("size")],
        {"size": F.col("size")}, ("source",)).drop("_bucket", "size_total")
    plan = plan.withColumnRenamed("source", "_source").withColumn("_factor", F.when(F.col("blocks") > 0, _multiplier()))
    known = placed.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("_source")))
    return known.select(
        "doc_id", "size", "source_size", "target", _taken(shards, seed).alias("by_shard")
    ).select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("by_shard", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"), "by_shard")


def _taken(shards: int, seed: int) -> Column:
    """Words of a row that each shard takes: over the blocks it reaches into, copies of the block times the words in it."""
    first, end = F.col("size_before"), F.col("size_before") + F.col("size")
    none = F.array(*[F.lit(0).cast("long")] * shards)

    def copies(place: Column, s: int) -> Column:
        """Walks through the permutation that reach this place before the quota of the first s + 1 shards ends."""
        quota = F.get("quota", F.lit(s))
        return F.when(quota > place, _whole(quota - place + F.col("blocks") - 1, F.col("blocks"))).otherwise(F.lit(0).cast("long"))

    def add(acc: Column, block: Column) -> Column:
        words = F.least(end, _start(block + 1)) - F.greatest(first, _start(block))

        def split(place: Column) -> Column:
            up_to = [copies(place, s) for s in range(shards)]
            now = [up_to[0], *[b - a for a, b in zip(up_to, up_to[1:], strict=False)]]
            return F.array(*[F.get(acc, F.lit(s)) + words * n for s, n in enumerate(now)])

        return let(_place(block, seed), split)

    spanned = F.sequence(_block(first), _block(end - 1))
    return F.when(F.col("size") > 0, F.aggregate(spanned, none, add)).otherwise(none)
