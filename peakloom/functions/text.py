"""Text and number readers, keys and seeded order scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.functions.binding import let
from peakloom.schema import MULTIPLICITIES, MULTIPLICITY_ALIASES, UNKNOWN_MULTIPLICITY

# Every character that counts as white space, also outside ASCII.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
# Number shapes accepted by the source readers.
DECIMAL_TEXT = r"^[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?$"
# Most numbers: no white space, no exponent and too short to overflow.
PLAIN_TEXT = r"\A[-+]?\d{1,200}(?:\.\d*)?\z"
COUNT_TEXT = r"^(\d+)(?:\.0+)?\s*[Hh]?$"
J_NUMBER = r"([-+]?(?:\d+(?:\.\d*)?|\.\d+))"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def optional_text(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def first_text(*candidates: Column) -> Column:
    """The first candidate that is not blank."""
    return F.coalesce(*[optional_text(c) for c in candidates])


def normalize_multiplicity(c: Column) -> Column:
    """Vocabulary label, `<unk>` for a label outside it, null for no label.

    The labels are in lower case, so a text that is one already is not converted.
    """
    known = literal_map({**{m: m for m in MULTIPLICITIES}, **MULTIPLICITY_ALIASES})
    as_given, folded = (F.try_element_at(known, text) for text in (c, F.lower(strip(c))))
    return F.coalesce(as_given, folded, F.when(c.isNotNull(), F.lit(UNKNOWN_MULTIPLICITY)))


def is_finite(c: Column) -> Column:
    """True for a finite double, false for NaN and infinities, null for null."""
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_double(c: Column) -> Column:
    """The finite number written in a text column, else null."""
    value = let(strip(c), lambda text: F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double")))
    other = let(value, lambda v: F.when(is_finite(v), v))
    return F.when(c.rlike(PLAIN_TEXT), c.try_cast("double")).otherwise(other)


def unreadable_number(c: Column) -> Column:
    """True where a value was supplied but is not a finite number."""
    return c.isNotNull() & finite_double(c).isNull()


def non_negative_integer(c: Column) -> Column:
    """Reads `0`, `2.0`, `2H`, `3.0 h`; blank and unreadable texts give null."""
    return F.regexp_extract(strip(c), COUNT_TEXT, 1).try_cast("bigint")


def unreadable_integer(c: Column) -> Column:
    return non_negative_integer(c).isNull() & optional_text(c).isNotNull()


def j_values_from_text(c: Column) -> Column:
    """All numbers in the text; null, blank and `_` mean an empty list."""
    text = F.coalesce(strip(c), F.lit("_"))
    found = F.regexp_extract_all(text, F.lit(J_NUMBER), F.lit(1))
    return F.transform(found, lambda v: v.cast("double"))


def unreadable_j_text(c: Column) -> Column:
    text = strip(c)
    return (
        text.isNotNull()
        & ~text.isin("", "_")
        & (F.regexp_count(text, F.lit(J_NUMBER)) == 0)
    )


def j_values_from_array(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<double>"))


def numeric_label(c: Column) -> Column:
    """A finite endpoint label; `1.0` and `1.00` become the same number."""
    return finite_double(c)


def seeded_score(key: Column, seed: int) -> Column:
    """16 hex digits that order like the first eight digest bytes, big endian."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}\0"), key), 256), 1, 16)


def seeded_digest(key: Column, seed: int) -> Column:
    """Full digest of `seed:key`, the other seeded ordering."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def connectivity_key(identity_key: Column) -> Column:
    return F.split_part(identity_key, F.lit("-"), F.lit(1))


def molecule_key(key: Column, record_id: Column) -> Column:
    """The key, or a per-record stand-in so keyless records never match."""
    return F.when(F.length(key) > 0, key).otherwise(
        F.concat(F.lit("__missing_smiles__:"), record_id)
    )


def binary_key_text(key: Column) -> Column:
    """ASCII keys as text, other keys as lower-case hex."""
    ascii_only = F.hex(key).rlike("^([0-7][0-9A-F])*$")
    return F.when(ascii_only, F.decode(key, "US-ASCII")).otherwise(F.lower(F.hex(key)))


def row_identifier(identifier: Column, row_index: Column) -> Column:
    return F.coalesce(
        identifier.cast("string"), F.concat(F.lit("row-"), row_index.cast("string"))
    )


def record_id(*parts) -> Column:
    """Parts joined by colons; null if any part is, so that such records fail validation and never share an ID."""
    texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(texts[0], *[x for t in texts[1:] for x in (F.lit(":"), t)])


def display_name(value: Column, names: dict[str, str]) -> Column:
    """A fixed display name where one is given, else the value itself."""
    return F.coalesce(F.try_element_at(literal_map(names), value), value)


def mean_sd_text(mean: Column, sd: Column, n: Column, digits: int = 4) -> Column:
    one = F.format_string(f"%.{digits}f", mean)
    return F.when(n == 1, one).otherwise(
        F.concat(one, F.lit(" ± "), F.format_string(f"%.{digits}f", sd))
    )


def primary_score(dataset: Column, classification: tuple[str, ...], auc: Column, r2: Column):
    """(metric name, score): AUC for classification endpoints, R² otherwise."""
    is_class = dataset.isin(*classification)
    return (
        F.when(is_class, F.lit("roc_auc")).otherwise(F.lit("r2")),
        F.when(is_class, auc).otherwise(r2),
    )
