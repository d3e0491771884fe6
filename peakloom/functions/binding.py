"""Small helpers that keep Catalyst from evaluating the same expression twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once.

    Inside a lambda Spark repeats a subexpression wherever it is written; a
    one-element transform binds it to a variable instead.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def exploded(df: DataFrame, *keep, items: Column | str, name: str = "item") -> DataFrame:
    """One row per non-null array element.

    The outer form plus a filter gives the rows of a plain explode, but without
    the inferred size and null tests that would compute `items` three times.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def pos_exploded(df: DataFrame, *keep, items: Column | str, pos: str = "position", name: str = "item") -> DataFrame:
    """One row per array element with its 0-based position."""
    return df.select(*keep, F.posexplode_outer(items).alias(pos, name)).filter(F.col(pos).isNotNull())
