"""Fingerprints, anchors, crowded anchors and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from peakloom.llm import simhash
from peakloom.llm.components import components


def fingerprint(text):
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    words = [w for w in (text or "").encode().translate(table).replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    spans = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs):
    """Smallest node reachable from each node, by union of sets."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("text", ["", " \t", "One", "a b c", "a b c d", "a  B\tc\nd e", "É é\u2003x y z", "w " * 70_000, None])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") % 2**64 == fingerprint(text)


def test_anchors_are_all_near_code_words(spark):
    draw = random.Random(4)
    words = [0, 1, 2**31 - 1, *[draw.getrandbits(31) for _ in range(40)]]
    rows = spark.createDataFrame([(w,) for w in words], "w long").select("w", simhash.near_anchors(F.col("w")).alias("at"))
    for r in rows.collect():
        assert len(set(r["at"])) == len(r["at"]) == (1 if r["at"] == [r.w] else 16)
        for a in r["at"]:
            positions = [p for p in range(1, 32) if a >> (p - 1) & 1]
            assert not np.bitwise_xor.reduce(positions or [0]) and bin(a ^ r.w).count("1") <= 2
    # two words within two bits always share an anchor
    pairs = [(w, w ^ 1 << i ^ 1 << j) for w in words[:12] for i in range(31) for j in range(i, 31)]
    both = spark.createDataFrame(pairs, "a long, b long").select(
        F.arrays_overlap(simhash.near_anchors(F.col("a")), simhash.near_anchors(F.col("b"))).alias("meet"))
    assert {r.meet for r in both.collect()} == {True}


@pytest.mark.parametrize("crowd", [4096, 6])
def test_links_connect_what_brute_force_connects(spark, crowd):
    draw = random.Random(7)
    values = [draw.getrandbits(64) for _ in range(150)]
    for v in values[:40]:
        for _ in range(4):
            for _ in range(draw.randrange(1, 6)):
                v ^= 1 << draw.randrange(64)
            values.append(v)
    values += [0, 1, 3, 2**64 - 1, *[sum(1 << b for b in draw.sample(range(64), 3)) for _ in range(150)]]  # a crowd
    signed = sorted({v - 2**64 if v >> 63 else v for v in values})
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), crowd).collect()
    apart = [bin((r.a ^ r.b) & (2**64 - 1)).count("1") for r in found]
    assert len(found) > 100
    if crowd > 1000:
        got = groups([(r.a, r.b) for r in found])
    else:
        assert {r.a for r in found} <= set(signed)
        got = groups([(r.a, r.b) for r in found])
    want = groups([(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4])
    assert got == want and apart


def test_components_of_paths_stars_and_loops(spark):
    draw = random.Random(9)
    pairs = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 40)] + [(900, 900), (901, 902), (902, 901)]
    pairs += [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(150)]
    draw.shuffle(pairs)
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {a: b for a, b in groups(pairs).items() if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(9, text), (4, text + " end"), (4, text + " end"), (7, text.upper()), (1, None), (2, ""), (3, "alone here"), (None, text),
            (None, "nobody knows this")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component_id int")
    found = simhash.near_duplicates(docs).collect()
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in found), key=repr)
    want = {None: 4, 9: 4, 4: 4, 7: 4, 1: 1, 2: 1, 3: 3}
    assert len(got) == 9 and all(c == want[k] for k, _, c in got if k is not None)
    assert sorted(repr(c) for k, _, c in got if k is None) == ["4", "None"]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
