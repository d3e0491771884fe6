"""Ranked search against a plain scan of all documents, and the limit on accumulators."""

import math
import random
import re

import numpy as np

from peakloom.llm import ranked_search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string, item int, score string", "item_id long, text string, rank int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k=10):
    """`(item_id, rank, doc_id, score)` by the formula, every document against every item."""
    words = [WORD.findall(lowered(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    found = []
    for item_id, text in sorted(set(items), key=repr):
        scores = []
        for (doc_id, _), w in zip(docs, words, strict=True):
            score = 0
            for t in WORD.findall(lowered(text)):
                if t in w:
                    tf, m = w.count(t), 25 + (75 * len(w) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item_id, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return found


def searched(spark, docs, items, **options):
    a = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return [tuple(r) for r in ranked_search.ranked_search(a, b, **options).select("item_id", "rank", "doc_id", "score").collect()]


def made(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "日本", "x-y", "A1"]
    return draw, [" ".join(draw.choices(words, weights=range(1, len(words) + 1), k=draw.randrange(0, 60))) for _ in range(n)]


def test_against_a_plain_scan(spark):
    draw, texts = made(1, 300)
    docs = list(enumerate(texts))
    items = [(i, t) for i, t in enumerate(made(2, 25)[1])]
    assert sorted(searched(spark, docs, items)) == sorted(brute(docs, items))
    assert sorted(searched(spark, docs, items, terms_a_pass=20)) == sorted(brute(docs, items))


def test_ties_nulls_repeats_and_long_texts(spark):
    same = "alpha beta"
    docs = [(9, same), (3, same), (3, same), (None, same), (None, None), (4, None), (5, ""), (6, " .;"), (2**63 - 1, same),
            (7, "alpha " * 100_000 + "rare"), (8, "ALPHA gamma"), (-1, "delta"), (10, "delta"), (11, "delta epsilon")]
    items = [(1, same), (1, same), (1, "gamma rare"), (None, "delta"), (2, None), (3, ""), (4, "unknown"), (5, "alpha alpha ALPHA beta")]
    for k in (1, 3, 10):
        assert sorted(searched(spark, docs, items, k=k), key=repr) == sorted(brute(docs, items, k), key=repr)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, "a")], [(1, "a")]) == brute([(1, "a")], [(1, "a")])


def test_accumulators_stop_opening_and_scores_stay_exact():
    draw = np.random.default_rng(4)
    n = np.full(5000, 100)
    lists = [np.sort(np.concatenate([[1] * (i < 40), np.flatnonzero(draw.random(6) < 0.7) + 2])).astype(int) for i in range(5000)]
    sizes = np.array([len(x) for x in lists])
    term = np.concatenate(lists)
    block = ranked_search.Block.of(n, sizes, term, np.ones(len(term), int), 5000, 500_000)
    item = [(1, 5000)] + [(t, 300) for t in range(2, 8)]
    scores = np.full(5000, -1, dtype=np.int64)
    places, total, opened = ranked_search.scored(block, item, 10, 1, scores)
    assert (scores == -1).all() and opened == len(places) == 40  # the common terms open nothing
    gain = 1_000_000_000 // (1000 + 8 * 100)
    full = {p: sum(dict(item)[t] * gain for t in lists[p]) for p in range(5000)}
    best = sorted(full.values())[-10:]
    assert sorted(total)[-10:] == best and all(full[p] == s for p, s in zip(places.tolist(), total.tolist(), strict=True))
    assert ranked_search.scored(block, item, 10, 10**12, scores)[2] == 0  # a floor from other blocks opens nothing at all
