"""The mixture against a direct allocation seat by seat and a walk through every word."""

import random

import pytest

from peakloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, rank int, quota int"


def made(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA)


def targets(sizes):
    """Targets by sharing again and again what the stopped sources leave."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        found = {s: 3 * sizes[s] if s in stopped else left * weight[s] / sum(weight[r] for r in rest) for s in names}
        over = {s for s in rest if found[s] > 3 * sizes[s]}
        if not over:
            return names, found
        stopped |= over


def allocated(votes, most, seats):
    """Winner of each seat in turn: the highest quotient, ties to the earlier source."""
    won, order = [0] * len(votes), []
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if won[i] < most[i]), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
        order.append(best)
    return order


CASES = {
    "even": {"a": 700, "b": 900, "c": 800},
    "small sources": {"a": 3000, "b": 40, "c": 5, "d": 1, "e": 0, None: 77},
    "stopped in turn": {"a": 10, "b": 100, "c": 1000, "d": 90, "e": 3000, "f": 5, "g": 2, "Z": 33, "é": 500},
    "one": {None: 400},
    "hot": {"a": 20, "hot": 5000, "zz": 2500, "zzz": 2500},
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_mixture(spark, name):
    draw, left, rows = random.Random(name), dict(CASES[name]), []
    while any(left.values()):
        for s in left:
            n = min(left[s], draw.choice([1, 5, 60, 300]))
            left[s] -= n
            rows.append((len(rows) if draw.random() < 0.9 else None, " ".join(["w"] * n) + draw.choice(["", "\n", " \t"]), s))
    rows += [(1, None, s) for s in left] + [(2, "", "a" if "a" in left else None)] + rows[:3]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names, aim = targets(sizes)
    found = mixing.mixed(made(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.source_size) for r in found) == sorted(
        (i is None, i or 0, len((t or "").split()), sizes[s]) for i, t, s in rows)
    assert all(r.taken == sum(r.by_shard) <= 3 * r["size"] and len(r.by_shard) == 4 for r in found)
    by_target = {}
    for r in found:
        by_target[r.source_size, round(r.target, 6)] = by_target.get((r.source_size, round(r.target, 6)), 0) + r.taken
    expected = {}
    for s in names:
        expected[sizes[s], round(aim[s], 6)] = expected.get((sizes[s], round(aim[s], 6)), 0) + aim[s]
    assert by_target.keys() == expected.keys()
    assert all(abs(by_target[k] - expected[k]) <= 2 * 33 for k in expected)
    again = mixing.mixed(made(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_quotas_seat_by_seat(spark):
    draw = random.Random(2)
    sizes = [draw.choice([3, 40, 300, 5000]) * draw.randrange(1, 9) for _ in range(40)] + [64] * 5 + [0]
    given = [(f"s{i:02}", n, i, float(min(3 * n, draw.choice([n / 2, n, 2.5 * n, 3 * n])))) for i, n in enumerate(sizes)]
    table = spark.createDataFrame(given, "source string, source_size long, rank long, target double")
    rows = sorted(mixing.quotas(table, shards=3).collect(), key=lambda r: r["rank"])
    assert [r.blocks for r in rows] == [max(1, int(n / 32 + 0.5)) if n else 0 for n in sizes]
    votes = [r.target * r.blocks / r.source_size if r.source_size else 0.0 for r in rows]
    seats = (sum(int(v * 1024) for v in votes) + 512) // 1024
    order = allocated(votes, [3 * r.blocks for r in rows], seats)
    for s in range(3):
        first = order[: seats * (s + 1) // 3]
        assert [r.quota[s] for r in rows] == [first.count(i) for i in range(len(rows))]


def test_no_rows_and_no_words(spark):
    assert mixing.mixed(made(spark, [])).collect() == []
    found = mixing.mixed(made(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in found) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_every_place_of_the_permutation_is_used_once(spark):
    table = spark.createDataFrame([(r, b, j) for r, b in enumerate([1, 2, 7, 33, 1000]) for j in range(b)], "rank int, blocks long, j long")
    placed = table.withColumn("_factor", mixing._multiplier()).select("rank", "blocks", mixing._place(mixing.F.col("j"), 42).alias("p"))
    counts = placed.groupBy("rank", "blocks").agg(mixing.F.count_distinct("p").alias("d"), mixing.F.min("p").alias("a"), mixing.F.max("p").alias("b"))
    assert all((r.d, r.a, r.b) == (r.blocks, 0, r.blocks - 1) for r in counts.collect())
