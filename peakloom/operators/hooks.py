"""Where a user's own Python meets the tables: always in Arrow batches.

The hook receives one batch of texts or rows and answers for each of them; the
operators add a status and never lose a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK, MISSING, INVALID, FAILED = "ok", "missing_smiles", "invalid_smiles", "calculation_error"


def with_status(
    rows: DataFrame, text: str, compute: Callable[[str], dict | None], fields: T.StructType
) -> DataFrame:
    """One output row per input row: record_id, text, status, error and `fields`.

    `compute` answers a dict, or None for a text it cannot read. An exception
    becomes the status `calculation_error` with its message.
    """
    names = fields.names
    schema = T.StructType([
        T.StructField("record_id", T.StringType()), T.StructField(text, T.StringType()),
        T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
        *fields.fields,
    ])

    def answer(record_id, value):
        row = {"record_id": record_id, text: value, "error": None, **dict.fromkeys(names)}
        if value is None or not str(value).strip():
            return row | {"status": MISSING, "error": "empty text"}
        try:
            found = compute(value)
        except Exception as error:
            return row | {"status": FAILED, "error": str(error)}
        if found is None:
            return row | {"status": INVALID, "error": "the text could not be read"}
        return row | {"status": OK} | {n: found.get(n) for n in names}

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = [answer(r, v) for r, v in zip(part["record_id"], part[text])]
            yield pd.DataFrame(answers, columns=schema.names).astype(object)

    return rows.select("record_id", text).mapInPandas(batches, schema)


def key_hook(derive: Callable[[str], str | None]) -> Callable[[Column], dict[str, Column]]:
    """A structure hook for the conform functions from a text -> key function."""
    @F.pandas_udf(T.StringType())
    def derived(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else derive(t))

    return lambda text: {"smiles": text, "smiles_canonical": derived(text)}


def embed(
    records: DataFrame,
    issues: Column,
    encode: Callable[[pd.DataFrame], list],
    inputs: list[str],
    on_incompatible: str = "skip",
) -> tuple[DataFrame, DataFrame]:
    """(embeddings, rejected): run an encoder on the compatible records.

    `issues` is an issue array, such as a dialect's. `skip` reports incompatible
    records; `error` fails the job at the first one.
    """
    if on_incompatible not in ("skip", "error"):
        raise ValueError("on_incompatible must be skip or error")
    marked = records.withColumn("_issues", issues)
    if on_incompatible == "error":
        stop = F.when(F.size("_issues") > 0, F.raise_error(F.concat(F.lit("incompatible record "), "record_id")).cast("boolean"))
        marked = marked.filter(stop.isNull())

    def batches(parts):
        for part in parts:
            yield pd.DataFrame({"record_id": part["record_id"], "embedding": list(encode(part))})

    embedded = marked.filter(F.size("_issues") == 0).select(
        "record_id", *[c for c in inputs if c != "record_id"]
    ).mapInPandas(batches, "record_id string, embedding array<float>")
    rejected = marked.filter(F.size("_issues") > 0).select("record_id", F.col("_issues").alias("issues"))
    return embedded, rejected
