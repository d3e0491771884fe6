"""Winnowed decontamination against a direct search for item windows."""

import random
import re
import time

import pytest

from peakloom.llm import decontaminate


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(text, items):
    words, hit, names = tokens(text), set(), set()
    for name, item in items:
        w = tokens(item)
        n = min(10, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                if name is not None:
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def passage(draw, n, vocabulary):
    return " ".join(draw.choice(vocabulary) for _ in range(n))


def case(seed):
    draw = random.Random(seed)
    vocabulary = ["ab", "É", "c3", "x", "Yy"] if seed % 2 else [f"w{i}" for i in range(60)]
    items = [(i, passage(draw, n, vocabulary)) for i, n in enumerate([30, 10, 11, 25, 25])]
    items += [(7, passage(draw, 9, vocabulary)), (8, passage(draw, 6, vocabulary)), (9, ""), (10, None), (None, items[0][1])]
    items += [items[0], (11, items[3][1][:40] + " zz " + items[4][1][-40:])]
    docs = []
    for d in range(25):
        parts = [passage(draw, draw.randrange(0, 40), vocabulary)]
        for _ in range(draw.randrange(0, 3)):
            w = (draw.choice(items)[1] or "").split()
            a = draw.randrange(0, max(1, len(w) - 8))
            parts += [", ".join(w[a:a + draw.randrange(5, 30)]).upper(), passage(draw, 3, vocabulary)]
        docs.append((d, " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "!!"), (None, items[0][1]), (0, docs[0][1]), (0, items[1][1])], items


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("listed,broadcast", [(True, True), (False, True), (False, False), (True, False)])
def test_equals_direct_search(spark, seed, listed, broadcast, monkeypatch):
    if not listed:
        monkeypatch.setattr(decontaminate, "LISTED_PRINTS", 0)
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_PRINTS", 0)
    docs, items = case(seed)
    table = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, n_words int, item_id string")
    found = decontaminate.contamination(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found), key=repr)
    assert got == sorted(((k, *expected(t, items)) for k, t in docs), key=repr)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in found)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(docs, items.limit(0)).collect()] == [0]
    assert decontaminate.contamination(docs.limit(0), items).collect() == []


def test_long_text_and_plan(spark):
    item = " ".join(f"q{i}" for i in range(12))
    text = "fill " * 60_000 + item + " fill" * 60_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [(r.n_words, r.n_hit) for r in found.collect()] == [(120_012, 12)]
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("listed", [20_000, 0])
def test_time_grows_with_the_text_not_its_square(spark, listed, monkeypatch):
    """Many distinct words, so that every window keeps other fingerprints; a passage at the end is found."""
    monkeypatch.setattr(decontaminate, "LISTED_PRINTS", listed)
    draw, item = random.Random(6), " ".join(f"q{i}" for i in range(14))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    seconds = []
    for n in (1000, 250_000, 500_000):
        text = " ".join(f"w{draw.randrange(10**7)}" for _ in range(n)) + " " + item
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.perf_counter()
        found = decontaminate.contamination(docs, items).collect()
        seconds.append(time.perf_counter() - begun)
        assert [(r.n_words, r.n_hit) for r in found] == [(n + 14, 14)]
    assert seconds[2] < 3 * seconds[1] + 5
