"""Ranked lexical search by accumulator-limited, term-at-a-time scoring.

Documents are cut into terms once; what stays of a document are the numbers of
the query terms in it. Collection statistics (documents, terms, document
frequencies) are counted over all documents. Then every block of documents is
inverted to postings, and each item scores the block term by term, rarest
first. A posting opens an accumulator for its document only while the bounds of
the terms still to come can lift a new document to the score that the k-th best
has already; after that only documents with an accumulator are updated, and
those exactly. A task keeps its best k of each item, whose last score also
limits the accumulators of its later blocks; the lists of all tasks are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import list_array, staged

#: Bytes that a term is made of: 0-9, A-Z (lowered), a-z and all bytes of characters beyond ASCII.
_TERM = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes((b + 32 if 0x41 <= b < 0x5B else b) if b in _TERM else 0x20 for b in range(256))
#: Terms of the items that one pass over the documents looks for, repeats included; more items take more passes.
TERMS_A_PASS = 2_000_000
#: Largest document ID, which also stands for a null one in the order of ties.
LAST = (1 << 63) - 1
FOUND = "item int, doc_id long, no_id boolean, score long"


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, with repeats; null has none."""
    return text.translate(TABLE).split() if text else []


@dataclass(frozen=True)
class Items:
    """Query terms, numbered from one, and each item's distinct terms with their repeats."""

    numbers: dict[bytes, int]
    lists: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Items:
        numbers: dict[bytes, int] = {}
        lists = []
        for text in texts:
            found = np.array([numbers.setdefault(t, len(numbers) + 1) for t in terms(text)], dtype=np.int64)
            lists.append(np.unique(found, return_counts=True))
        return cls(numbers, lists)


def count_terms(text: Column, numbers: dict[bytes, int]) -> Column:
    """`n` terms of a whole text, and `term` numbers and `tf` of the query terms in it."""
    @F.arrow_udf("n long, term array<int>, tf array<int>")
    def counted(column: pa.Array) -> pa.Array:
        get, n, at, often = numbers.get, [], [], []
        for data in column.cast(pa.binary()).to_pylist():
            words = terms(data)
            n.append(len(words))
            term, tf = np.unique(np.array(list(filter(None, map(get, words))), dtype=np.int32), return_counts=True)
            at.append(term)
            often.append(tf.astype(np.int32))
        sizes, none = [len(t) for t in at], np.zeros(0, np.int32)
        lists = [list_array(np.concatenate([none, *x]), sizes) for x in (at, often)]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), *lists], ["n", "term", "tf"])

    return counted(text)


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of `size` query terms; one row per term and task is summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size + 1)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    rows = counted.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = np.zeros(size + 1, dtype=np.int64)
    for r in rows.collect():
        found[r["term"]] = r["df"]
    return found


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """What a weight is multiplied by: the part of a score that depends on the document alone."""
    m = 25 + (75 * n * n_documents) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Block:
    """Postings of consecutive documents: of each term the documents' places and impacts, and the largest impact."""

    size: int
    edges: dict[int, tuple[int, int]]
    places: np.ndarray
    impact: np.ndarray
    most: dict[int, int]

    @classmethod
    def of(cls, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n_documents: int, n_terms: int) -> Block:
        place = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(term, kind="stable")
        place, term = place[order], term[order]
        impact = impacts(tf[order].astype(np.int64), n[place], n_documents, n_terms)
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(term))
        most = np.maximum.reduceat(impact, starts) if len(starts) else starts
        names = term[starts].tolist()
        return cls(len(n), dict(zip(names, zip(starts.tolist(), ends.tolist()))), place, impact, dict(zip(names, most.tolist())))


def scored(block: Block, item: list[tuple[int, int]], k: int, floor: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and exact scores of all documents that can be among the best `k`, and the postings opened.

    `item` lists terms, rarest first, with the weight times the repeats;
    `floor` is a score that k documents elsewhere reach. `scores` is all -1 on
    entry and on return; a document has an accumulator once it is zero or more.
    """
    held = [(t, w) for t, w in item if w and t in block.edges]
    rest = sum(w * block.most[t] for t, w in held)
    open_, opened, growing = [], 0, True
    for t, w in held:
        a, b = block.edges[t]
        at, gain = block.places[a:b], block.impact[a:b] * w
        if growing and rest < floor:
            growing = False
        old = scores[at]
        if growing:
            fresh = at[old < 0]
            scores[fresh] = 0
            scores[at] += gain
            open_.append(fresh)
            opened += len(fresh)
        else:
            known = old >= 0
            scores[at[known]] += gain[known]
        rest -= w * block.most[t]
        if growing and opened >= k and rest:  # the k-th best partial score; no score falls later
            partial = scores[np.concatenate(open_)]
            floor = max(floor, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
    places = np.concatenate([np.zeros(0, np.int64), *open_])
    total = scores[places]
    scores[places] = -1
    return places, total, opened


def _best(ids: np.ndarray, none: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Order of the best k: higher scores, then smaller IDs, a null one last."""
    return np.lexsort((none, ids, -score))[:k]


def _search(items: list[list[tuple[int, int]]], k: int, n_documents: int, n_terms: int):
    """A mapper from counted documents to the best k of each item in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [nothing] * len(items)
        for batch in batches:
            key = batch.column(0)
            none = key.is_null().to_numpy(zero_copy_only=False)
            ids = key.fill_null(LAST).to_numpy()
            lists = batch.column(2)
            block = Block.of(
                batch.column(1).to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(),
                batch.column(3).flatten().to_numpy(), n_documents, n_terms,
            )
            scores = np.full(block.size, -1, dtype=np.int64)
            for i, item in enumerate(items):
                kept = best[i]
                floor = int(kept[2][-1]) if len(kept[2]) >= k else 1
                places, total, _ = scored(block, item, k, floor, scores)
                good = total >= floor
                if good.any():
                    places, total = places[good], total[good]
                    both = [np.concatenate(x) for x in zip(kept, (ids[places], none[places], total), strict=True)]
                    top = _best(*both, k)
                    best[i] = tuple(x[top] for x in both)
        rows = [np.repeat(np.arange(len(items), dtype=np.int32), [len(b[0]) for b in best])]
        rows += [np.concatenate([nothing[j], *[b[j] for b in best]]) for j in range(3)]
        ids = pa.array(rows[1], mask=rows[2]) if len(rows[1]) else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0]), ids, pa.array(rows[2]), pa.array(rows[3])], ["item", "doc_id", "no_id", "score"])

    return run


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", terms_a_pass: int = TERMS_A_PASS,
) -> DataFrame:
    """`item_id, rank, doc_id, score`: the `k` highest-scoring documents of every item, scores above zero only.

    Equal scores go to the smaller document ID, a null one last. Every row of
    `docs` is a document, so repeated rows rank one after the other, and null or
    empty texts are in no list. Item rows equal in ID and text count once; an
    ID with several texts has a list for each of them. Items without terms, or
    with terms of no weight only, and empty tables give no rows. Other columns
    are not read. Items travel to the tasks; a pass takes items of about
    `terms_a_pass` terms, so more items than that are searched in several
    passes over the documents.
    """
    distinct = staged(
        items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).distinct()
        .withColumn("size", F.octet_length(F.coalesce("text", F.lit("")))), "search-items")
    passes = max(1, -(-int(distinct.agg(F.sum("size")).first()[0] or 0) // (4 * terms_a_pass)))
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lists = None
    for p in range(passes):
        asked = distinct.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == p).select("item_id", "text")
        found = _one_pass(source, asked, k, distinct.schema["item_id"].dataType.simpleString())
        lists = found if lists is None else lists.unionAll(found)
    return lists


def _one_pass(docs: DataFrame, asked: DataFrame, k: int, id_type: str) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.collect()  # at most about TERMS_A_PASS terms
    items = Items.of([None if r["text"] is None else r["text"].encode() for r in rows])
    counted = staged(
        docs.select("doc_id", count_terms(F.col("text"), items.numbers).alias("c"))
        .select("doc_id", "c.n", "c.term", "c.tf"), "search-documents")
    totals = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = document_frequencies(counted, len(items.numbers))
    weights = [weight(totals["documents"], d) for d in df.tolist()]
    ordered = []
    for term, repeats in items.lists:
        rarest = np.lexsort((term, df[term]))
        ordered.append([(int(term[i]), weights[term[i]] * int(repeats[i])) for i in rarest])
    search = _search(ordered, k, totals["documents"], max(1, totals["terms"]))
    found = counted.filter(F.size("term") > 0).mapInArrow(search, FOUND)
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {id_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
