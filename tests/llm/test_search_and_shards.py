"""Exact top-k and byte shards against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import sharding, topk


def brute(rows, k):
    found = []
    for q, a in rows:
        if q % 20 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in rows if c != q]
            found += [(q, i, c, -s) for i, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize(("dense", "blocks"), [(True, (8, 4)), (False, (50, 3)), (False, (1000, 1000))])
def test_top_k_equals_brute_force(spark, dense, blocks):
    draw = random.Random(1)
    rows = [(i, [draw.randrange(-3, 4) if dense or draw.random() < 0.2 else 0 for _ in range(6)]) for i in range(130)]
    rows += [(i, [1, 1, 1, 1, 1, 1]) for i in range(200, 240)]  # ties
    vectors = spark.createDataFrame([(i, [x / 64 for x in v], "q") for i, v in rows], "vec_id int, vec array<float>, score string")
    ints = topk.integer_vectors(vectors)
    found = topk.exact_top_k(ints, F.col("vec_id") % 20 == 0, 5, *blocks).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute(rows, 5)


def test_unsound_and_short_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (6, []), (6, []),
            (None, [1.0, 1.0]), (7, [-0.001, 1e9])]
    ints = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, vec array<double>"))
    found = topk.exact_top_k(ints, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(7, -64 + 32 * 64 * 10**9), (5, 4096), (6, 0)]
    assert topk.exact_top_k(ints.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.exact_top_k(ints.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).collect() == []


def test_block_top_with_few_candidates():
    q, c, s = topk.block_top(np.array([4]), np.array([[1]]), np.array([4, 2, 3]), np.array([[9], [1], [1]]), 5)
    assert (c.tolist(), s.tolist()) == ([2, 3], [1, 1])


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_byte_shards_equal_brute_force(spark, shards):
    draw = random.Random(3)
    docs = [(draw.randrange(300), "é" * draw.randrange(0, 50)) for _ in range(200)]
    docs += [(400, "z" * 100_000), (401, None), (402, ""), (None, "n"), (403, "same"), (403, "same")]
    table = spark.createDataFrame([(*d, 1, 1) for d in docs], "doc_id long, text string, size int, shard int").repartition(9)
    found = sharding.byte_shards(table, shards).collect()
    rows = sorted((k is not None, k or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for k, t in docs)
    total, before, slots, want = sum(r[3] for r in rows), 0, [0] * shards, []
    for known, k, crc, size in rows:
        s = min(shards - 1, (2 * before + size) * shards // (2 * total))
        want.append((k if known else None, size, crc, s, slots[s]))
        before, slots[s] = before + size, slots[s] + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found), key=repr) == sorted(want, key=repr)
    assert sharding.byte_shards(table.limit(0), shards).collect() == []
