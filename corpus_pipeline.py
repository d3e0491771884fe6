"""From raw documents to token IDs: rate, deduplicate, decontaminate, redact, encode.

Each stage works on all rows that the one before it kept, and its result is
written as Parquet and read back before the next one begins. All stages but
the last return the columns of `documents`. Empty tables pass through. Stages
with Python functions bound the session's Arrow batches (`bound_batches`).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.llm import decontaminate, near_copies, pii, quality
from peakloom.llm.catalog import with_digests
from peakloom.llm.common import bound_batches, id_remainder, staged
from peakloom.operators.prefilter import flagged

TOKENIZER = "word_bpe_49k.json"
GOOD = 0.3


def spare(docs: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the quality cut; labels of held-out IDs are not learned from.

    Null and empty texts are rated like a text without words, very long ones
    whole, repeated rows alike. Labels of one class only, or none, reject
    nothing. An empty table stays empty; other columns pass through unread.
    """
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train_quality(docs, labels, id_remainder(F.col("doc_id"), 5) != 0)
    return docs.filter(quality.quality_score(F.col("text"), model) >= GOOD)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest ID, then the smallest text digest.

    A null ID comes after all others. Rows are dropped only as near copies of
    the row that stays; of rows equal in ID and text the one whose other columns
    come first as JSON text stays. Null texts are copies of each other, and so
    are texts without words; very long texts are compared whole. Only rows that
    are in a group, or repeated, are moved.
    """
    bound_batches(spark)
    groups = near_copies.near_copies(docs)
    digest = near_copies.text_id(F.col("text"))
    keys = staged(docs.select("doc_id", digest.alias("tid")).groupBy("tid", "doc_id").agg(F.count("*").alias("n")), "copies-keys")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
    rooted = keys.join(groups, "tid")
    leaders = rooted.groupBy("root").agg(F.min(order).alias("least")).withColumnRenamed("root", "of")
    judged = rooted.join(leaders, F.col("root") == F.col("of"))
    leads = (F.col("tid") == F.col("least.tid")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    # the rows that go, and those of which one stays; all others are left where they are
    touched = judged.filter(~leads | (F.col("n") > 1)).select("tid", "doc_id", leads.alias("leads"))
    tid, identity, lead, flag, rank = (spare(docs, c) for c in ("_tid", "_id", "_leads", "_flag", "_rank"))
    touched = staged(touched, "copies-touched").toDF(f"{tid}t", identity, lead)
    texts = touched.select(F.col(f"{tid}t").alias(tid)).distinct()
    rows = flagged(docs.withColumn(tid, digest), staged(texts, "copies-texts"), [tid], flag)
    matched = (F.col(tid) == F.col(f"{tid}t")) & F.col("doc_id").eqNullSafe(F.col(identity))
    untouched = rows.filter(~F.col(flag)).unionAll(rows.filter(F.col(flag)).join(touched, matched, "left_anti"))
    repeated = rows.filter(F.col(flag)).join(touched.filter(F.col(lead)), matched)
    columns = list(map(quoted, docs.columns))
    one = Window.partitionBy("doc_id", tid).orderBy(F.to_json(F.struct(*columns)))
    kept = repeated.withColumn(rank, F.row_number().over(one)).filter(F.col(rank) == 1)
    return untouched.select(*columns).unionAll(kept.select(*columns))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item.

    If several rows share an ID, one contaminated row removes them all; rows
    without an ID are decided by their text. Null and empty texts have no
    windows and stay; very long texts are searched whole.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = spare(docs, "_row")
    by_text = F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    keyed = docs.withColumn(row, F.coalesce(F.col("doc_id").cast("string"), by_text))
    hit = decontaminate.contamination(keyed, benchmark, key=row).filter("contaminated").select(row).distinct()
    return keyed.join(hit, row, "left_anti").select(*map(quoted, docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by the kind of data.

    A null text stays null, an empty one empty; very long texts are redacted
    whole and repeated rows alike. `n_chars`, if present, is counted anew.
    """
    bound_batches(spark)
    clean = docs.withColumn("text", pii.redact(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*map(quoted, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `lang` and `source` where there are such columns, token IDs, their number, and digests of IDs and decoded text.

    A null text is encoded like the empty one, to no IDs; very long texts are
    encoded whole and repeated rows alike. Other columns are left out.
    """
    bound_batches(spark)
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return with_digests(docs.select(*kept, "text"), public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("pii", redact),
    ("bpe", encode),
]
ORACLE_SQL = None  # classifier, minimum hashes and byte-pair merges are beyond SQL; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
