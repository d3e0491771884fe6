"""The canonical record schema, its closed vocabularies and its size limits."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "2"

# The closed multiplicity vocabulary, in model-index order.
MULTIPLICITIES = (
    "m", "d", "s", "dd", "t", "ddd", "q", "dt", "td", "br", "ddt",
    "dq", "tt", "quint", "dddd", "qd", "sept", "ddp", "ddq", "bd", "dqd",
)
# Accepted spellings of vocabulary labels.
MULTIPLICITY_ALIASES = {"p": "quint", "hept": "sept", "brd": "bd"}
UNKNOWN_MULTIPLICITY = "<unk>"

# Size limits and plausible shift ranges (ppm).
MAX_PEAKS = 60
MAX_J_VALUES = 6
H_CLEAN_RANGE = (-5.0, 20.0)
C_CLEAN_RANGE = (-50.0, 300.0)
C_RAW_AUDIT_RANGE = (-20.0, 300.0)
H_BIN_RANGE = (-5.5, 20.0)
C_BIN_RANGE = (-40.0, 300.0)

PROTON_PEAK = T.StructType([
    T.StructField("shift", T.DoubleType()),
    T.StructField("integration", T.LongType()),
    T.StructField("multiplicity_raw", T.StringType()),
    T.StructField("multiplicity", T.StringType()),
    T.StructField("j_values", T.ArrayType(T.DoubleType())),
    T.StructField("range_min", T.DoubleType()),
    T.StructField("range_max", T.DoubleType()),
    T.StructField("range_half_span", T.DoubleType()),
    T.StructField("equivalence_class", T.LongType()),
    T.StructField("member_shifts", T.ArrayType(T.DoubleType())),
])

CARBON_PEAK = T.StructType([
    T.StructField("shift", T.DoubleType()),
    T.StructField("integral", T.DoubleType()),
    T.StructField("intensity", T.DoubleType()),
    T.StructField("width", T.DoubleType()),
])

CANONICAL = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("smiles", T.StringType()),
    T.StructField("smiles_canonical", T.StringType()),
    T.StructField("molecular_formula", T.StringType()),
    T.StructField("nmr_frequency", T.StringType()),
    T.StructField("nmr_solvent", T.StringType()),
    T.StructField("atoms", T.ArrayType(T.StringType())),
    T.StructField("h_nmr_peaks", T.ArrayType(PROTON_PEAK)),
    T.StructField("c_nmr_peaks", T.ArrayType(CARBON_PEAK)),
])

# Descriptor and flag columns of the property side table.
DESCRIPTORS = (
    "exact_molecular_weight", "calculated_logp", "tpsa", "hba", "hbd",
    "rotatable_bonds", "fraction_csp3", "aromatic_atom_fraction",
)
FUNCTIONAL_FLAGS = (
    "has_amine", "has_amide", "has_alcohol_or_phenol", "has_ester",
    "has_carboxylic_acid", "has_aldehyde_or_ketone", "has_nitrile",
    "has_halogenated_group", "has_heteroaromatic_ring",
)
MORGAN_BYTES = 256
MACCS_BITS = 166

_INTEGER_DESCRIPTORS = ("hba", "hbd", "rotatable_bonds")

SIDECAR = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("smiles_canonical", T.StringType()),
        T.StructField("rdkit_status", T.StringType()),
        T.StructField("rdkit_error", T.StringType()),
    ]
    + [
        T.StructField(
            name, T.IntegerType() if name in _INTEGER_DESCRIPTORS else T.DoubleType()
        )
        for name in DESCRIPTORS
    ]
    + [T.StructField(name, T.ByteType()) for name in FUNCTIONAL_FLAGS]
    + [
        T.StructField("morgan_ecfp4_2048", T.BinaryType()),
        T.StructField("maccs_keys_166_bits", T.StringType()),
    ]
)


def same_shape(left: T.DataType, right: T.DataType) -> bool:
    """Equal names and types, ignoring nullability (file sources relax it)."""
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        return left.names == right.names and all(
            same_shape(a.dataType, b.dataType) for a, b in zip(left, right)
        )
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        return same_shape(left.elementType, right.elementType)
    return left == right
