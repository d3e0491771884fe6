"""Random numbers that depend only on seed, purpose and key.

The same record gets the same numbers on every run and under any partitioning,
also after a task is retried, which `rand()` cannot promise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.functions.binding import let

_DIGITS = 13
_SCALE = float(16**_DIGITS)


def digest(seed: int, purpose: str, *key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[k.cast("string") for k in key]), 256)


def uniform(hex_digest: Column, draw: int = 0) -> Column:
    """A uniform number in [0, 1); one digest holds four independent draws."""
    if not 0 <= draw <= 3:
        raise ValueError("a digest holds draws 0 to 3")
    digits = F.substring(hex_digest, 1 + _DIGITS * draw, _DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(_SCALE)


def normal(hex_digest: Column, draw: int = 0) -> Column:
    """A standard normal from draws `draw` and `draw + 1` (Box-Muller)."""
    def of(d):
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(d, draw)))
        return radius * F.cos(F.lit(2.0 * math.pi) * uniform(d, draw + 1))

    return let(hex_digest, of)
