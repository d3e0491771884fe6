"""Source rows to canonical rows, one narrow projection per source shape.

Every function adds the canonical columns and `conform_issues`, the list of
places that could not be read. Nothing is dropped here; `route` separates or
fails afterwards. All of it runs on bounded and on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions import peaks as P
from peakloom.functions import text as X
from peakloom.functions.binding import let
from peakloom.functions.text import is_finite
from peakloom.operators.validate import issue, joined, peak_path, per_peak, present, record_issues
from peakloom.schema import CANONICAL, CARBON_PEAK, PROTON_PEAK

STRUCTURE_CODE = "missing_structure"
HYDROGEN, CARBON = 1, 6


def proton(shift: Column, **fields: Column) -> Column:
    """A full proton struct; fields that are not given are null."""
    values = {"shift": shift, **fields}
    return F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PROTON_PEAK.fields
    ])


def carbon(shift: Column, **fields: Column) -> Column:
    values = {"shift": shift, **fields}
    return F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CARBON_PEAK.fields
    ])


def _canonical(df: DataFrame, columns: dict[str, Column], issues: Column) -> DataFrame:
    """Add canonical columns (missing ones as null) and the issue list."""
    cast = [
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL.fields
    ]
    return df.select(*cast, issues.alias("conform_issues"))


def normalise_modalities(df: DataFrame) -> DataFrame:
    """Null modality lists become empty lists."""
    return df.withColumns({
        "h_nmr_peaks": P.filled(F.col("h_nmr_peaks"), P.EMPTY_PROTONS),
        "c_nmr_peaks": P.filled(F.col("c_nmr_peaks"), P.EMPTY_CARBONS),
    })


def identity_structure(text: Column) -> dict[str, Column]:
    """Default key hook: the source text is taken as the canonical key."""
    return {"smiles": text, "smiles_canonical": text}


def _structure(text: Column, hook) -> tuple[dict[str, Column], Column]:
    columns = hook(text)
    missing = present(issue(
        columns["smiles_canonical"].isNull(), STRUCTURE_CODE, F.lit("smiles"),
        "needs a readable structure text",
    ))
    return columns, missing


def _rich_numbers(p: Column) -> Column:
    """The parsed numbers of one raw peak."""
    return F.struct(
        X.finite_double(p["range_min"]).alias("low"),
        X.finite_double(p["range_max"]).alias("high"),
        X.finite_double(F.coalesce(p["centroid"], p["delta"])).alias("given"),
        X.optional_text(p["category"]).alias("label"),
    )


def _rich_proton(p: Column, n: Column) -> Column:
    def build(shift):
        start, end = F.coalesce(n["low"], shift), F.coalesce(n["high"], shift)
        return proton(
            shift,
            integration=X.non_negative_integer(p["n_h"]),
            multiplicity_raw=n["label"],
            multiplicity=X.normalize_multiplicity(n["label"]),
            j_values=X.j_values_from_text(p["j_values"]),
            range_min=start,
            range_max=end,
            range_half_span=(end - start) / F.lit(2.0),
        )

    middle = F.when(p["centroid"].isNull() & p["delta"].isNull(), (n["low"] + n["high"]) / F.lit(2.0))
    return let(F.coalesce(n["given"], middle), build)


def _rich_proton_issues(p: Column, n: Column, i: Column) -> Column:
    def at(suffix=""):
        return peak_path("h_nmr_peaks", i, suffix)

    given = F.coalesce(p["centroid"], p["delta"])
    low, high = p["range_min"], p["range_max"]
    number = "must be a finite number"
    return present(
        issue(low.isNull() != high.isNull(), "incomplete_range", at(), "needs both range ends or neither"),
        issue(low.isNotNull() & n["low"].isNull(), "invalid_number", at(".range_min"), number),
        issue(high.isNotNull() & n["high"].isNull(), "invalid_number", at(".range_max"), number),
        issue(n["low"] > n["high"], "invalid_range", at(), "range_min must not exceed range_max"),
        issue(given.isNotNull() & n["given"].isNull(), "invalid_number", at(".shift"), number),
        issue(given.isNull() & low.isNull(), "missing_shift", at(),
              "needs a centroid, a delta or both range ends"),
        issue(X.unreadable_integer(p["n_h"]), "invalid_integration", at(".integration"),
              "must look like a non-negative integer or 2H"),
        issue(X.unreadable_j_text(p["j_values"]), "invalid_j_values", at(".j_values"),
              "contains no number"),
    )


def _with_numbers(peaks: Column, numbers_of) -> Column:
    """Each raw peak beside its parsed numbers, for building and for checking."""
    return F.transform(peaks, lambda p: F.struct(p.alias("raw"), numbers_of(p).alias("n")))


def _rich_carbon(p: Column, keep: bool) -> Column:
    extra = {
        "integral": X.finite_double(p["integral"]),
        "intensity": X.finite_double(p["intensity"]),
        "width": X.finite_double(p["width_ppm"]),
    } if keep else {}
    return carbon(X.finite_double(p["delta_ppm"]), **extra)


def _rich_carbon_issues(keep: bool):
    def of(p, i):
        checks = [issue(X.finite_double(p["delta_ppm"]).isNull(), "invalid_number",
                        peak_path("c_nmr_peaks", i, ".shift"), "must be a finite number")]
        if keep:
            checks += [
                issue(X.unreadable_number(p[source]), "invalid_number",
                      peak_path("c_nmr_peaks", i, f".{name}"), "must be a finite number")
                for name, source in (("integral", "integral"), ("intensity", "intensity"), ("width", "width_ppm"))
            ]
        return present(*checks)

    return of


def conform_rich(
    landing: DataFrame, source: str, prefix: str, keep_carbon_properties: bool, structure=identity_structure
) -> DataFrame:
    """Annotated peak lists with text fields; simulated ones keep carbon values.

    Landing columns: key, split, smiles, smiles_canonical, nmr_frequency,
    nmr_solvent, h_peaks (centroid, delta, range_min, range_max, category, n_h,
    j_values), c_peaks (delta_ppm, integral, intensity, width_ppm).
    """
    columns, missing = _structure(X.first_text(F.col("smiles"), F.col("smiles_canonical")), structure)
    staged = landing.withColumn("_h", _with_numbers(F.col("h_peaks"), _rich_numbers))
    h, c = F.col("_h"), F.col("c_peaks")
    columns |= {
        "record_id": X.record_id(prefix, F.col("split"), F.col("key")),
        "source": F.lit(source),
        "nmr_frequency": X.optional_text(F.col("nmr_frequency")),
        "nmr_solvent": X.optional_text(F.col("nmr_solvent")),
        "h_nmr_peaks": F.transform(h, lambda z: _rich_proton(z["raw"], z["n"])),
        "c_nmr_peaks": F.transform(c, lambda p: _rich_carbon(p, keep_carbon_properties)),
    }
    issues = joined(
        missing,
        per_peak(h, lambda z, i: _rich_proton_issues(z["raw"], z["n"], i)),
        per_peak(c, _rich_carbon_issues(keep_carbon_properties)),
    )
    return normalise_modalities(_canonical(staged, columns, issues))


def _tokenised_numbers(x: Column) -> Column:
    """The parsed parts of one [shift, half span, label, integration, J list]."""
    j_text = F.get(x, F.lit(4))
    read = F.transform(F.from_json(j_text, "array<string>"), X.finite_double)
    return F.struct(
        X.finite_double(F.get(x, F.lit(0))).alias("shift"),
        X.finite_double(F.get(x, F.lit(1))).alias("half"),
        F.when(j_text == "[]", F.array().cast("array<double>")).otherwise(read).alias("j"),
    )


def _tokenised_proton(x: Column, n: Column) -> Column:
    return let(X.optional_text(F.get(x, F.lit(2))), lambda label: _labelled_proton(x, n, label))


def _labelled_proton(x: Column, n: Column, label: Column) -> Column:
    return proton(
        n["shift"],
        integration=X.non_negative_integer(F.get(x, F.lit(3))),
        multiplicity_raw=label,
        multiplicity=X.normalize_multiplicity(label),
        j_values=X.j_values_from_array(n["j"]),
        range_min=n["shift"] - n["half"],
        range_max=n["shift"] + n["half"],
        range_half_span=n["half"],
    )


def _tokenised_issues(x: Column, n: Column, i: Column) -> Column:
    def at(suffix=""):
        return peak_path("h_nmr_peaks", i, suffix)

    bad_j = (F.get(x, F.lit(4)).isNotNull() & n["j"].isNull()) | F.exists(n["j"], lambda v: v.isNull())
    checks = present(
        issue(n["shift"].isNull(), "invalid_number", at(".shift"), "must be a finite number"),
        issue(F.get(x, F.lit(1)).isNotNull() & n["half"].isNull(), "invalid_number",
              at(".range_half_span"), "must be a finite number"),
        issue(n["half"] < 0, "negative_half_span", at(".range_half_span"), "must not be negative"),
        issue(X.unreadable_integer(F.get(x, F.lit(3))), "invalid_integration", at(".integration"),
              "must look like a non-negative integer or 2H"),
        issue(bad_j, "invalid_j_values", at(".j_values"), "must be a list of finite numbers"),
    )
    short = F.coalesce(F.size(x) < 5, F.lit(True))
    incomplete = present(issue(short, "incomplete_peak", at(), "needs five parts"))
    return F.when(short, incomplete).otherwise(checks)


def parse_tokenised(text: Column) -> Column:
    """The two peak lists of a tokenised JSON text, all parts as text."""
    return F.from_json(text, "`1HNMR` array<array<string>>, `13CNMR` array<string>")


def _lost_list(name: str) -> Column:
    """The text holds a list that the parser could not read as one."""
    given = F.get_json_object("tokenized_input", f"$.{name}")
    return F.col("_spectra")[name].isNull() & given.isNotNull()


def _not_json() -> Column:
    """The text is no JSON object.

    Over a fault inside one list the parser may still give the other, so the text
    is read again unless both lists are there, or where it may hold a number that
    the parser takes but JSON lacks.
    """
    text, spectra = F.col("tokenized_input"), F.col("_spectra")
    unread = spectra["1HNMR"].isNull() | spectra["13CNMR"].isNull()
    lenient = F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("INF")) | F.contains(text, F.lit("Infinity"))
    brace = F.lit("{")
    is_object = F.startswith(text, brace) | F.startswith(F.ltrim(text, F.lit(X.WHITESPACE)), brace)
    return ~F.coalesce(is_object, F.lit(False)) | ((unread | lenient) & F.get_json_object(text, "$").isNull())


def conform_tokenised(landing: DataFrame, source: str, prefix: str, structure=identity_structure) -> DataFrame:
    """Five-part proton tuples and carbon shifts inside a JSON text column.

    Landing columns: id, row_index, split, original_smiles, smiles, tokenized_input.
    """
    spectra = parse_tokenised(F.col("tokenized_input"))
    staged = landing.withColumn("_spectra", spectra).withColumn(
        "_h", _with_numbers(F.col("_spectra")["1HNMR"], _tokenised_numbers)
    )
    columns, missing = _structure(X.first_text(F.col("original_smiles"), F.col("smiles")), structure)
    h = F.col("_h")
    c = F.col("_spectra")["13CNMR"]
    row = F.col("row_index")
    columns |= {
        "record_id": X.record_id(
            prefix, F.col("split"), X.row_identifier(F.col("id"), row),
            F.concat(F.lit("row-"), row.cast("string")),
        ),
        "source": F.lit(source),
        "h_nmr_peaks": F.transform(h, lambda z: _tokenised_proton(z["raw"], z["n"])),
        "c_nmr_peaks": F.transform(c, lambda s: carbon(X.finite_double(s))),
    }
    issues = joined(
        missing,
        present(
            issue(_not_json(), "invalid_json", F.lit("tokenized_input"), "must be a JSON object"),
            issue(_lost_list("1HNMR"), "invalid_peak_list", F.lit("h_nmr_peaks"), "must be a list of lists"),
            issue(_lost_list("13CNMR"), "invalid_peak_list", F.lit("c_nmr_peaks"), "must be a list"),
        ),
        per_peak(h, lambda z, i: _tokenised_issues(z["raw"], z["n"], i)),
        per_peak(c, lambda s, i: present(issue(
            X.finite_double(s).isNull(), "invalid_number", peak_path("c_nmr_peaks", i, ".shift"), "must be a finite number"))),
    )
    return normalise_modalities(_canonical(staged, columns, issues))


def _nucleus_groups(element: int) -> Column:
    """(class, member shifts) of one element, classes in first-seen order."""
    atoms = F.filter(
        F.arrays_zip(F.col("shifts"), F.col("atom_numbers"), F.col("equivalence_classes")),
        lambda a: a["atom_numbers"] == element,
    )

    def members(found, k):
        own = F.filter(found, lambda a: a["equivalence_classes"].eqNullSafe(k))
        return F.struct(k.alias("k"), F.transform(own, lambda a: a["shifts"]).alias("members"))

    def grouped(found):
        classes = F.array_distinct(F.transform(found, lambda a: a["equivalence_classes"]))
        return F.transform(classes, lambda k: members(found, k))

    return let(atoms, grouped)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def conform_atoms(landing: DataFrame, source: str, prefix: str, structure=identity_structure) -> DataFrame:
    """Atom-level arrays grouped to peaks by equivalence class; no shuffle.

    Landing columns: key (binary), smiles, canonical_smiles, shifts,
    atom_numbers, equivalence_classes (parallel arrays).
    """
    columns, missing = _structure(X.first_text(F.col("smiles"), F.col("canonical_smiles")), structure)
    same = (F.size("shifts") == F.size("atom_numbers")) & (
        F.size("atom_numbers") == F.size("equivalence_classes")
    )
    columns |= {
        "record_id": X.record_id(prefix, X.binary_key_text(F.col("key"))),
        "source": F.lit(source),
        "h_nmr_peaks": F.transform(
            _nucleus_groups(HYDROGEN),
            lambda g: proton(
                _mean(g["members"]), integration=F.size(g["members"]),
                equivalence_class=g["k"], member_shifts=g["members"],
            ),
        ),
        "c_nmr_peaks": F.transform(_nucleus_groups(CARBON), lambda g: carbon(_mean(g["members"]))),
    }
    kept = F.filter(
        F.arrays_zip(F.col("shifts"), F.col("atom_numbers"), F.col("equivalence_classes")),
        lambda a: F.coalesce(a["atom_numbers"].isin(HYDROGEN, CARBON), F.lit(True)),
    )
    unreadable = F.exists(
        kept,
        lambda a: a["atom_numbers"].isNull()
        | a["equivalence_classes"].isNull()
        | F.coalesce(~is_finite(a["shifts"]), F.lit(True)),
    )
    issues = joined(
        missing,
        present(
            issue(~F.coalesce(same, F.lit(False)), "length_mismatch", F.lit("shifts"),
                  "the three arrays must have the same length"),
            issue(same & unreadable, "invalid_number", F.lit("shifts"),
                  "needs finite shifts, atomic numbers and classes"),
        ),
    )
    return normalise_modalities(_canonical(landing, columns, issues))


def conform_shifts(landing: DataFrame, source: str, prefix: str, structure=identity_structure) -> DataFrame:
    """Two shift lists without annotations.

    Landing columns: split, row_index, smiles, h_shift, c_shift.
    """
    columns, missing = _structure(X.optional_text(F.col("smiles")), structure)
    h, c = F.col("h_shift"), F.col("c_shift")

    def unreadable(modality):
        return lambda s, i: present(issue(
            F.coalesce(~is_finite(s), F.lit(True)), "invalid_number", peak_path(modality, i, ".shift"), "must be a finite number"))

    columns |= {
        "record_id": X.record_id(prefix, F.col("split"), F.col("row_index")),
        "source": F.lit(source),
        "h_nmr_peaks": F.transform(h, lambda s: proton(s)),
        "c_nmr_peaks": F.transform(c, lambda s: carbon(s)),
    }
    issues = joined(
        missing, per_peak(h, unreadable("h_nmr_peaks")), per_peak(c, unreadable("c_nmr_peaks"))
    )
    return normalise_modalities(_canonical(landing, columns, issues))


def routed(conformed: DataFrame, quarantine: tuple[str, ...] = (STRUCTURE_CODE,)) -> DataFrame:
    """Canonical rows and `reason`: null if accepted, else the codes of what sets the row aside; other issues abort.

    What conversion produced is validated here too, so a record that breaks a
    rule of the schema is never accepted. Each row is read, validated and
    judged once: the generator keeps filters on `reason` from repeating that.
    """
    def judged(found):
        fatal = F.filter(found, lambda x: ~x["code"].isin(*quarantine))
        message = F.concat(
            F.coalesce("record_id", F.lit("<no ID>")), F.lit(": "),
            F.concat_ws("; ", F.transform(fatal, lambda x: F.concat(x["path"], F.lit(" "), x["message"]))),
        )
        codes = F.transform(found, lambda x: x["code"])
        return F.when(
            F.exists(found, lambda x: ~x["code"].isin(*quarantine)), F.raise_error(message).cast("string")
        ).when(F.size(found) > 0, F.array_join(codes, ";"))

    reason = let(joined(F.col("conform_issues"), record_issues()), judged)
    row = F.struct(*conformed.drop("conform_issues").columns, reason.alias("reason"))
    return conformed.select(F.explode_outer(F.array(row)).alias("row")).select("row.*")


def route(conformed: DataFrame, quarantine: tuple[str, ...] = (STRUCTURE_CODE,)) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): structure failures are set aside, other issues abort.

    The two sides of `routed`, which gives both in one pass. Rejected rows
    carry record_id, source_smiles and reason.
    """
    rows = routed(conformed, quarantine)
    accepted = rows.filter(F.col("reason").isNull()).drop("reason")
    rejected = rows.filter(F.col("reason").isNotNull()).select(
        "record_id", F.col("smiles").alias("source_smiles"), "reason"
    )
    return accepted, rejected
