"""Near copies of five-word shingles against brute force, and the choice of one row of each group."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def made(draw, n):
    return [f"w{draw.randrange(100_000)}" for _ in range(n)]


def test_stage_removes_copies_of_similarity_0_8(spark):
    draw = random.Random(5)
    texts = []
    for _ in range(40):
        base = made(draw, draw.randrange(60, 200))
        texts.append(base)
        for share in (0.01, 0.02, 0.03, 0.06):  # changed words in one run, so few shingles are lost
            copy, at = list(base), draw.randrange(len(base) // 2)
            copy[at : at + max(1, int(share * len(base)))] = made(draw, max(1, int(share * len(base))))
            texts.append(copy)
    texts = [" ".join(t) for t in texts]
    sets = [near_copies.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and near_copies.similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    left = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").select("doc_id").collect()}
    assert left == set(root) and len(left) < len(texts)


def test_a_chain_across_the_ends_of_a_band_is_whole(spark):
    """Texts alike to a neighbour only: the first and last of a band do not join them all."""
    draw = random.Random(7)
    words = made(draw, 400)
    texts = [" ".join(words[i : i + 200]) for i in range(0, 200, 18)]
    sets = [near_copies.shingles(t) for t in texts]
    assert all(near_copies.similarity(a, b) >= 0.8 for a, b in zip(sets, sets[1:])) and near_copies.similarity(sets[0], sets[-1]) < 0.3
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()] == [0]


def test_short_wordless_and_null_texts():
    same, other = near_copies.shingles("A b  c"), near_copies.shingles("a b d")
    assert near_copies.similarity(near_copies.shingles("a b c"), same) == 1.0 and near_copies.similarity(same, other) == 0.0
    assert near_copies.similarity(near_copies.shingles(""), near_copies.shingles(" \n")) == 1.0
    least = np.array([near_copies.minimums(t) for t in (b"", b" ", b"a b")])
    keys = near_copies.band_keys(least)
    assert keys.shape == (3, near_copies.BANDS) and (keys[0] == keys[1]).all() and not set(keys[0]) & set(keys[2])
    assert len(set(keys[0])) == near_copies.BANDS


def test_signatures_estimate_similarity():
    draw = random.Random(9)
    words = made(draw, 3000)
    texts = [" ".join(words[i : i + 2000]) for i in (0, 50, 220, 600)]
    least = np.array([near_copies.minimums(t.encode()) for t in texts]).astype(np.uint8)
    sets = [near_copies.shingles(t) for t in texts]
    for i in range(1, 4):
        assert abs((least[0] == least[i]).mean() - near_copies.similarity(sets[0], sets[i])) < 0.12


def test_small_tiles_give_the_same_groups(spark):
    """A crowd of copies of copies, compared in one band and in many tiles."""
    draw = random.Random(11)
    core = made(draw, 300)
    texts = []
    for _ in range(90):
        copy, at = list(core), draw.randrange(280)
        copy[at : at + 12] = made(draw, 12)
        texts.append(" ".join(copy))
    texts += [" ".join(made(draw, 50) + core[:60]) for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    def groups(crowd):
        members = {}
        for r in near_copies.near_copies(docs, crowd=crowd).collect():
            members.setdefault(r.root, []).append(bytes(r.tid))
        return sorted(sorted(m) for m in members.values())

    whole = groups(near_copies.CROWD)
    assert whole == groups(8) and max(map(len, whole)) == 90 and len(whole) == 31


def joined(n, left, right):
    """Groups of places that links connect."""
    group = list(range(n))
    for a, b in zip(left, right, strict=True):
        group = [group[a] if g == group[b] else g for g in group]
    return [sorted(i for i in range(n) if group[i] == g) for g in sorted(set(group))]


def test_possible_links_connect_each_band_in_few_rows():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 256, (4, near_copies.HASHES), dtype=np.uint8)
    kind = draw.integers(0, 4, 150)
    signs = np.where(draw.random((150, near_copies.HASHES)) < 0.05, draw.integers(0, 256, (150, near_copies.HASHES)), base[kind]).astype(np.uint8)
    for edges in ([0, 150], [0, 3, 11, 18, 150], list(range(0, 151, 5))):
        a, b = near_copies._possible(signs, np.array(edges))
        expected = [[i for i in range(s, e) if kind[i] == k] for s, e in zip(edges, edges[1:]) for k in range(4)]
        assert sorted(joined(150, a, b)) == sorted(x for x in expected if x)
        assert len(a) <= 150 * near_copies.FEW / 2


def test_similar_sets_are_connected_as_by_comparing_all_pairs():
    draw = random.Random(6)
    for _ in range(20):
        sets = []
        for _ in range(30):
            start, n = draw.choice([0, 0, 3, 40, 200]), draw.choice([0, 1, 20, 25, 30, 60])
            sets.append(np.unique(np.array([start + i for i in range(n) if draw.random() < 0.95], dtype=np.uint64)))
        pairs = [(i, j) for i in range(30) for j in range(i) if near_copies.similarity(sets[i], sets[j]) >= 0.8]
        a, b = near_copies.similar(sets)
        assert sorted(joined(30, a, b)) == sorted(joined(30, [p[0] for p in pairs], [p[1] for p in pairs])) and len(a) < 30


def test_clashing_and_map_columns_stay(spark):
    schema = "doc_id long, text string, _tid string, _leader string, `a.b` int, _flag int, m map<string,int>"
    rows = [(1, "one two three", "x", "y", 1, 2, {"k": 1}), (2, "one two three", "p", "q", 1, 2, {"k": 2}),
            (3, "other words", None, None, None, None, None), (3, "other words", "z", None, None, None, {"k": 3})]
    docs = spark.createDataFrame(rows, schema)
    left = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert left.columns == docs.columns
    found = {r.doc_id: r for r in left.collect()}
    assert sorted(found) == [1, 3] and (found[1]["_tid"], found[1]["_leader"], found[1].m) == ("x", "y", {"k": 1})


def test_repeated_and_null_ids_lose_copies_only(spark):
    x, y, z = ("one two three four five six", "the river runs past old mills", "rain begins in a small town")
    rows = [(1, x, "en", "a", 1), (5, x, "en", "b", 1), (5, y, "en", "c", 1), (5, y, "en", "d", 1), (None, z, "en", "e", 1),
            (None, z, "en", "f", 1), (None, y, "en", "g", 1), (7, None, "en", "h", 1), (None, None, "en", "i", 1), (8, "", "en", "j", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(
        [(1, x, "en", "a", 1), (5, y, "en", "c", 1), (None, z, "en", "e", 1), (7, None, "en", "h", 1), (8, "", "en", "j", 1)], key=repr)


def test_linked_fingerprints_are_candidates(spark):
    """Texts that share no band, but whose fingerprints anchors link, come to one cluster."""
    rows = [(rid, [100 + rid], bytes(near_copies.HASHES), fp) for rid, fp in ((1, 0), (2, 0), (3, 0b1111), (4, 0b11111111), (5, -1), (6, -1))]
    marked = spark.createDataFrame([*rows, (7, None, None, None)], "rid long, keys array<long>, bytes binary, fp long")
    found = {}
    for r in near_copies._clusters(marked, near_copies.CROWD).collect():
        found.setdefault(r.group, set()).add(r.rid)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3, 4], [5, 6]]


def test_signature_has_the_fingerprint_of_five_word_shingles(spark):
    text = "One two three four five six seven two three four five six seven eight"
    row = spark.createDataFrame([(text,), ("",)], "text string").select(near_copies.signature(F.col("text")).alias("s")).select("s.*").collect()
    hashes = near_copies._hashes(text.encode())
    assert len(hashes) == 10 and len(near_copies.shingles(text)) == 8
    bits = [sum(int(h) >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
    assert [row[0].fp & (1 << 64) - 1, row[1].fp] == [sum(1 << b for b in range(64) if bits[b]), 0]
