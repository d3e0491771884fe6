"""Benchmark passages in documents, by winnowed fingerprints.

Both sides keep, of every window of consecutive k-gram hashes, the smallest
one. Two texts that share WINDOW words in a row share a kept k-gram inside
them, at the same place. Kept k-grams of the documents are joined with those
of the benchmark, and each hit is extended word by word to both sides, which
also confirms it. Since a shared window reaches at most WINDOW - K words past
a k-gram in it, the extension is bounded: a fingerprint row carries the few
words around it and decides its hit alone. Neither texts nor word lists are
copied or shuffled, and the work is linear in the length of a text. If the
benchmark has few fingerprints, documents look theirs up in a set before they
become rows. Items shorter than a window are looked up whole. DataFrame
functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.binding import exploded, let
from peakloom.llm.url_rules import LOWER, UPPER

WINDOW = 10
K = 5
#: Fingerprint rows of a benchmark up to this many are broadcast; more are joined by a shuffle on the hash.
BROADCAST_PRINTS = 200_000
#: Up to so many, documents look them up in a set before they become rows.
LISTED_PRINTS = 20_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS, -1), lambda w: w != "")


def gram_hashes(hashes: Column, size: int) -> Column:
    """Hash of each run of `size` word hashes; the size is part of the hash."""
    def gram(i):
        return F.xxhash64(F.lit(size), *[F.get(hashes, i + F.lit(j)) for j in range(size)])

    last = F.size(hashes) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), gram)).otherwise(
        F.array().cast("array<bigint>")
    )


def winnowed(grams: Column, width: int) -> Column:
    """`(pos, hash)` of every gram that is the minimum of some window of `width` grams.

    All positions that attain the minimum are kept, so the choice depends on
    the window's content alone. Fewer grams than `width` have no window.
    """
    def chosen(g: Column) -> Column:
        windows = F.size(g) - (width - 1)
        minima = F.transform(
            F.sequence(F.lit(0), F.greatest(windows - 1, F.lit(0))), lambda i: F.array_min(F.slice(g, i + 1, width))
        )
        at = F.transform(g, lambda h, i: F.struct(i.alias("pos"), h.alias("hash")))
        # the minima of the windows around a gram are at most its hash; it was chosen if one equals it
        kept = let(minima, lambda m: F.filter(
            at,
            lambda x: F.array_max(
                F.slice(m, F.greatest(x["pos"] - (width - 2), F.lit(1)),
                        F.least(x["pos"] + 1, F.lit(width)))
            ) == x["hash"],
        ))
        return F.when(windows > 0, kept).otherwise(F.filter(at, lambda x: F.lit(False)))

    return let(grams, chosen)


def prints(word_list: Column, whole: tuple[int, ...], only_whole: bool = False) -> Column:
    """Fingerprints `(pos, hash, n)` of a word list: winnowed k-grams, and all runs of the lengths in `whole`."""
    def placed(n: int) -> Callable[[Column, Column], Column]:
        return lambda h, i: F.struct(i.alias("pos"), h.alias("hash"), F.lit(n).alias("n"))

    def build(h: Column) -> Column:
        kept = [] if only_whole else [winnowed(gram_hashes(h, K), WINDOW - K + 1)]
        parts = [
            F.transform(k, lambda x: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), F.lit(0).alias("n")))
            for k in kept
        ]
        return F.concat(*parts, *[F.transform(gram_hashes(h, n), placed(n)) for n in whole])

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), build)


def _near(word_list: str, pos: Column) -> Column:
    """The words that the extension of a hit at `pos` may look at; null beyond the ends."""
    return F.array(*[F.get(word_list, pos + j) for j in range(K - WINDOW, WINDOW)])


def benchmark_prints(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, tuple[int, ...]]:
    """Fingerprint rows of a benchmark, and the lengths of its items shorter than a window."""
    items = benchmark.select(F.col(key).cast("string").alias("item_id"), words(F.col(text)).alias("item_words"))
    size = F.size("item_words")
    short = items.filter((size > 0) & (size < WINDOW)).select(size.alias("n")).distinct()
    lengths = tuple(sorted(r["n"] for r in short.collect()))
    found = F.when(size >= WINDOW, prints(F.col("item_words"), ()))
    for n in lengths:
        found = found.when(size == n, prints(F.col("item_words"), (n,), True))
    rows = exploded(items, "item_id", "item_words", items=found, name="p")
    return rows.select(
        "item_id", _near("item_words", F.col("p.pos")).alias("item_near"), F.col("p.hash").alias("hash"),
        F.col("p.n").alias("item_n"),
    ), lengths


def _span(doc_word: Callable[[int], Column]) -> tuple[Column, Column]:
    """First and past-the-end document word that a hit marks; null if the words differ or the run is short."""
    def same(j: int) -> Column:
        return F.coalesce(doc_word(j) == F.get("item_near", F.lit(j + WINDOW - K)), F.lit(False))

    def extent(offsets: list[int]) -> Column:
        run = F.when(~same(offsets[0]), 0)
        for i, j in enumerate(offsets[1:], 1):
            run = run.when(~same(j), i)
        return run.otherwise(len(offsets))

    gram, whole = F.lit(True), F.lit(True)
    for j in range(WINDOW - 1):
        if j < K:
            gram = gram & same(j)
        whole = whole & (same(j) | (F.col("n") <= j))
    left = extent([-1 - j for j in range(WINDOW - K)])
    right = extent([K + j for j in range(WINDOW - K)])
    fits = F.when(F.col("n") == 0, gram & (left + right + K >= WINDOW)).otherwise(whole)
    first = F.when(fits, F.col("pos") - F.when(F.col("n") == 0, left).otherwise(0))
    return first, F.col("pos") + F.when(F.col("n") == 0, right + K).otherwise(F.col("n"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, n_words, n_hit, n_items, items, contaminated` for each row of `docs`.

    `n_hit` counts document words inside occurrences of item windows, `items`
    lists the items with such windows in text order. Null and empty texts have
    no words; a null item key marks words but is no item; repeated items count
    once; repeated document rows give equal rows, as many as there are. Rows of
    equal key and different text are told apart by a hash of the text. An empty
    benchmark gives no hits. Other columns are not read.
    """
    index, lengths = benchmark_prints(benchmark)
    number = index.limit(max(BROADCAST_PRINTS, LISTED_PRINTS) + 1).count()
    itself = F.array(F.struct(
        F.lit(-1).alias("pos"), F.lit(None).cast("bigint").alias("hash"), F.size("words").alias("n"),
        F.lit(None).cast("array<string>").alias("near")))
    read = docs.select(
        F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"),
        words(F.col(text)).alias("words"),
    )
    found = prints(F.col("words"), lengths)
    if number <= LISTED_PRINTS:  # so many hashes at most are read here
        listed = [r["hash"] for r in index.select("hash").distinct().collect()]
        found = F.filter(found, lambda x: x["hash"].isin(listed))
    near = F.transform(found, lambda x: F.struct(
        x["pos"].alias("pos"), x["hash"].alias("hash"), x["n"].alias("n"), _near("words", x["pos"]).alias("near")))
    # the first entry stands for the row itself, so that rows without a hit come through; it has the number of words
    rows = exploded(read, "_key", "_text", items=F.concat(itself, near), name="p").select(
        "_key", "_text", "p.pos", "p.hash", "p.n", "p.near", F.when(F.col("p.pos") < 0, F.col("p.n")).alias("n_words"))
    joined = rows.join(F.broadcast(index) if number <= BROADCAST_PRINTS else index, "hash", "left")
    first, past = _span(lambda j: F.get("near", F.lit(j + WINDOW - K)))
    hit = F.when(F.col("n") == F.col("item_n"), first)
    found = joined.select(
        "_key", "_text", "n_words", F.when(F.col("n_words").isNull(), hit).alias("first"), past.alias("past"), "item_id"
    ).filter(F.col("n_words").isNotNull() | F.col("first").isNotNull())
    marked = F.col("first").isNotNull()
    summed = found.groupBy("_key", "_text").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count("n_words").alias("_copies"),
        F.array_sort(F.collect_set(F.when(marked, F.struct("first", "past")))).alias("_spans"),
        F.array_sort(F.collect_set(F.when(marked, F.col("item_id")))).alias("items"),
    )
    none = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).alias("reach"))

    def extend(acc: Column, s: Column) -> Column:
        fresh = F.greatest(s["past"] - F.greatest(s["first"], acc["reach"]), F.lit(0))
        reach = F.greatest(acc["reach"], s["past"])
        return F.struct((acc["hit"] + fresh).alias("hit"), reach.alias("reach"))

    return exploded(
        summed, F.col("_key").alias(key), "n_words",
        F.aggregate("_spans", none, extend, lambda acc: acc["hit"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items", (F.size("_spans") > 0).alias("contaminated"),
        items=F.sequence(F.lit(1), F.col("_copies").cast("int")), name="_copy",
    ).drop("_copy")
