"""The shared test tables seen as spectra, pools, labels and embedding caches.

Orders with their line items become nested peak records: open lines are proton
peaks, filled lines carbon peaks. All shifts are exact in binary, so any engine
computes the same values. Every 25th order also appears as a less annotated copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import peaks as P
from peakloom.functions.text import normalize_multiplicity
from peakloom.operators.conform import carbon, proton


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Raw labels by line number, among them aliases, padding and an unknown one.
RAW_LABELS = {1: "s", 2: " D ", 3: "p", 4: "brd", 5: "hept", 6: "xyz"}


def line_peaks(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """One row per line item with all peak fields, flat.

    `by_order` brings the lines of an order into one task, as `collected` needs
    them. The narrow source rows move; the peak fields are made afterwards.
    """
    line, defect = F.col("l_linenumber"), F.col("l_suppkey") % 50
    is_h = F.col("l_linestatus") == "O"
    shift = F.when(is_h, F.col("l_quantity") * 0.5625 - 6.0).otherwise(F.col("l_extendedprice") / 256.0 - 60.0)
    raw = F.coalesce(*[F.when(line == n, F.lit(label)) for n, label in RAW_LABELS.items()])
    source = table(spark, sf_dir, "lineitem")
    lines = (source.repartition("l_orderkey") if by_order else source).select(
        F.col("l_orderkey").alias("ok"),
        F.when(is_h, "h").otherwise("c").alias("nucleus"),
        shift.alias("shift"),
        F.when((F.col("l_returnflag") == "N") & (line == 1), None).otherwise(line % 7).cast("bigint").alias("integration"),
        raw.alias("mraw"),
        F.when(F.col("l_tax") < 0.015, None).when(line == 6, 0).otherwise(line).alias("n_j"),
        (F.col("l_discount") * 100).alias("j_value"),
        (line * 0.015625).alias("w"),
        defect.alias("defect"),
        line.alias("line_no"),
        (F.col("l_partkey") % 5).alias("eq_class"),
        F.col("l_quantity").alias("integral"),
        F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("intensity"),
        F.col("l_tax").alias("width"),
    )
    shift, w, no_range = F.col("shift"), F.col("w"), F.col("line_no") == 3
    defect = F.col("defect")
    return lines.withColumns({
        "range_min": F.when(no_range, None).when(defect == 1, shift + w).when(defect == 2, shift + 8.0 - w).otherwise(shift - w),
        "range_max": F.when(no_range | (defect == 0), None).when(defect == 1, shift - w).when(defect == 2, shift + 8.0 + w).otherwise(shift + w),
        "half": F.when(no_range, None).when(defect == 3, -0.25).otherwise(w),
        "j_values": F.when(F.col("n_j").isNotNull(), F.array_repeat("j_value", F.col("n_j"))),
        "members": F.when(F.col("line_no") == 2, F.array(shift - 0.5, shift + 0.5)).when(
            F.col("line_no") == 5, F.array().cast("array<double>")
        ),
    })


def order_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record identities: every order, and a copy of every 25th."""
    kinds = F.when(F.col("o_orderkey") % 25 == 0, F.array(F.lit("rec"), F.lit("dup"))).otherwise(F.array(F.lit("rec")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ok"),
        F.explode(kinds).alias("kind"),
        F.col("o_orderpriority").alias("source"),
        F.concat(F.lit("M"), (F.col("o_custkey") % 50).cast("string")).alias("mol_key"),
        F.when(F.col("o_custkey") % 11 != 0, (F.col("o_custkey") % 40).cast("int")).alias("n_atoms"),
    ).withColumn("record_id", F.concat_ws("-", "kind", F.col("ok").cast("string")))


def collected(flat: DataFrame, key: str, h: Column, c: Column) -> DataFrame:
    """The proton and carbon structs of each key as sorted arrays.

    A record is one row, so its peaks have to fit one row. The flat rows come
    spread by key (`line_peaks` with `by_order`): lists gain nothing from partial
    aggregation, and the lists are then built in all tasks. The structs stand in
    a projection of their own, which runs as generated code; inside the
    aggregate they would be interpreted.
    """
    made = flat.select(
        key, F.when(F.col("nucleus") == "h", h).alias("h"), F.when(F.col("nucleus") == "c", c).alias("c"))
    return made.groupBy(key).agg(
        F.sort_array(F.collect_list("h")).alias("h_peaks"), F.sort_array(F.collect_list("c")).alias("c_peaks"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records; orders without lines become records without peaks."""
    h = proton(
        F.col("shift"), integration=F.col("integration"), multiplicity_raw=F.col("mraw"),
        multiplicity=normalize_multiplicity(F.col("mraw")), j_values=F.col("j_values"),
        range_min=F.col("range_min"), range_max=F.col("range_max"), range_half_span=F.col("half"),
        equivalence_class=F.col("eq_class"), member_shifts=F.col("members"),
    )
    c = carbon(F.col("shift"), integral=F.col("integral"), intensity=F.col("intensity"), width=F.col("width"))
    peaks = collected(line_peaks(spark, sf_dir, by_order=True), "ok", h, c)

    def less_annotated(p):
        for name in ("integration", "multiplicity_raw", "multiplicity"):
            p = p.withField(name, F.lit(None).cast("bigint" if name == "integration" else "string"))
        return p

    copied = F.when(
        F.col("kind") == "dup", F.sort_array(F.transform("h_peaks", less_annotated))
    ).otherwise(F.col("h_peaks"))
    text = F.lit(None).cast("string")
    return order_copies(spark, sf_dir).join(peaks, "ok", "left").select(
        "record_id", "source",
        F.col("mol_key").alias("smiles"), F.col("mol_key").alias("smiles_canonical"),
        text.alias("molecular_formula"), text.alias("nmr_frequency"), text.alias("nmr_solvent"),
        F.array_repeat(F.lit("C"), F.col("n_atoms")).alias("atoms"),
        P.filled(copied, P.EMPTY_PROTONS).alias("h_nmr_peaks"),
        P.filled(F.col("c_peaks"), P.EMPTY_CARBONS).alias("c_nmr_peaks"),
    )


def pools(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Order pools with the customer as molecule key."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("record_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("key"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderpriority").alias("source"),
    )
    pick = lambda name, keep=F.lit(True): orders.filter((F.col("source") == name) & keep).drop("cust")
    return {
        "bench": pick("1-URGENT"),
        "a": pick("2-HIGH", F.col("cust") % 7 == 0),
        "b": pick("3-MEDIUM", F.col("cust") % 5 == 0),
        "t": pick("5-LOW"),
        "d": pick("4-NOT SPECIFIED"),
    }


def text_key(c: Column) -> Column:
    """Document identity: a hash of the trimmed text with its leading block."""
    digest = F.sha2(F.btrim(c, F.lit(" \n")), 256)
    return F.concat(F.substring(digest, 1, 2), F.lit("-"), digest)


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("record_id"),
        text_key(F.col("text")).alias("key"), "source", "lang", "n_chars", "doc_id",
    )


# Sources whose documents are not in the record pool that labels are matched to. The pool and the labels below are
# fixtures in which some keys must stay without a match; `all_labels` and the queries named `_whole` cover every document.
OUTSIDE_SOURCES = ("src1", "src7", "src13")


def pool_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_records(spark, sf_dir).filter(~F.col("source").isin(*OUTSIDE_SOURCES))


def prop_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External labels on document identities; copies of a text disagree in part."""
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 3 != 0)
    return docs.select(
        F.col("lang").alias("endpoint"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train_val").alias("split"),
        text_key(F.col("text")).alias("key"),
        F.when(F.col("doc_id") % 4 < 2, (F.col("doc_id") % 2).cast("string")).otherwise(
            F.concat((F.col("doc_id") % 2).cast("string"), F.lit(".00"))).alias("label"),
        F.col("doc_id").alias("row_no"),
    )


def all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property row for every document; the third that `prop_labels` leaves out has a null label."""
    docs = table(spark, sf_dir, "documents")
    known = F.when(F.col("doc_id") % 4 < 2, (F.col("doc_id") % 2).cast("string")).otherwise(
        F.concat((F.col("doc_id") % 2).cast("string"), F.lit(".00")))
    return docs.select(
        F.col("lang").alias("endpoint"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train_val").alias("split"),
        text_key(F.col("text")).alias("key"), F.when(F.col("doc_id") % 3 != 0, known).alias("label"), F.col("doc_id").alias("row_no"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary labels with a score that has many ties."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "lang", "quality", "toxic", (F.col("n_chars") % 97).cast("double").alias("score"),
        (F.col("n_chars") % 89).cast("double").alias("score_toxic"),
    )


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v-"), F.col("vec_id").cast("string")).alias("record_id"), "vec_id", "embedding", "label")


def representations(spark: SparkSession, sf_dir: str, n: int = 3) -> dict[str, DataFrame]:
    """Embedding caches that each lack another tenth of the records."""
    all_rows = cache(spark, sf_dir)
    return {f"r{i}": all_rows.filter(F.col("vec_id") % 10 != i) for i in range(n)}


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows by representation, probe, seed and target."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("representation"), F.col("l_linestatus").alias("probe"),
            F.col("l_linenumber").alias("seed"), (F.col("l_suppkey") % 9).cast("string").alias("target"),
        )
        .agg(
            F.round(F.avg("l_quantity"), 6).alias("roc_auc"),
            F.round(F.avg("l_discount"), 6).alias("average_precision"),
            F.round(F.avg("l_tax"), 6).alias("mae"),
        )
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged metric values of runs; several may share a step."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("run"), F.col("event_type").alias("metric"),
        F.floor(F.col("event_id") / 200).alias("step"), F.col("ts").alias("logged"),
        "event_id", "value",
    )
