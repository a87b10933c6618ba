"""Selection of coded events: procedures, diagnoses, costs, notes, imaging and drugs."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from clinspark.functions.text import first_part, fold_accents
from clinspark.operators.codes import (
    Codes,
    filter_codes,
    filter_source,
    has_listed_prefix,
    match_codes,
    match_prefix_codes,
)
from clinspark.operators.groups import dedupe_on
from clinspark.reference_values import MIN_NOTE_LENGTH, NOTE_CLASS_MEETING, NOTE_STATUS_ACTIVE

# Imaging vocabulary -> column holding its concept.
MODALITY_COLUMNS = {"DICOM": "modality_concept_id", "SOURCE": "modality_source_concept_id"}


def select_procedures(
    procedures: DataFrame,
    visits: DataFrame,
    codes: Codes = None,
    claim_source: str | None = None,
    sources: Mapping[str, str] = {},
    drop_duplicates: bool = False,
) -> DataFrame:
    """Procedures with one of the codes, with their day and the source id of the visit."""
    df = filter_source(procedures, claim_source, sources)
    df = df.withColumn("procedure_date", F.to_date("procedure_datetime"))
    df = filter_codes(df, codes, "procedure_source_value")
    if drop_duplicates and codes is not None:
        df = dedupe_on(df, ["procedure_occurrence_id"])
    return df.join(visits.select("visit_occurrence_id", "visit_occurrence_source_value"), "visit_occurrence_id", "left")


def select_costs(
    costs: DataFrame,
    codes: Codes = None,
    claim_source: str | None = None,
    sources: Mapping[str, str] = {},
    drop_duplicates: bool = False,
) -> DataFrame:
    df = filter_source(costs.withColumnRenamed("cost_event_id", "visit_occurrence_id"), claim_source, sources)
    df = filter_codes(df, codes, "drg_source_value")
    return dedupe_on(df, ["cost_id"]) if drop_duplicates and codes is not None else df


def filter_status(conditions: DataFrame, statuses: str | Sequence[str] | None) -> DataFrame:
    """Keep diagnoses of one type or of a list of types; nothing given keeps all."""
    if not statuses:
        return conditions
    if isinstance(statuses, str):
        return conditions.filter(F.col("condition_status_source_value") == statuses)
    if isinstance(statuses, (list, tuple)):
        return conditions.filter(F.col("condition_status_source_value").isin(list(statuses)))
    raise TypeError("statuses should be a str or a list")


def select_conditions(conditions: DataFrame, codes: Codes, drop_duplicates: bool = False, dictionary: DataFrame | None = None) -> DataFrame:
    """Diagnoses whose code, or a leading part of it, is listed; `dictionary` as in `match_prefix_codes`."""
    column = "condition_source_value"
    if codes is None:
        df = conditions
    elif isinstance(codes, DataFrame):
        df = match_prefix_codes(conditions, codes, column, dictionary=dictionary)
    elif isinstance(codes, str):
        df = conditions.filter(has_listed_prefix(column, [codes]))
    elif isinstance(codes, (list, tuple)):
        df = conditions.filter(has_listed_prefix(column, codes))
    else:
        raise TypeError("codes should be a str, list, tuple or DataFrame")
    return dedupe_on(df, ["condition_occurrence_id"]) if drop_duplicates else df


def get_conditions(
    conditions: DataFrame,
    visits: DataFrame,
    care_sites: DataFrame,
    codes: Codes = None,
    claim_source: str | None = None,
    sources: Mapping[str, str] = {},
    statuses: str | Sequence[str] | None = None,
    drop_duplicates: bool = False,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Diagnoses by source, type and code, with visit and care site names.

    Every filter runs before the visits are joined, so only matching diagnoses reach the shuffle.
    """
    df = filter_status(filter_source(conditions, claim_source, sources), statuses)
    df = select_conditions(df, codes, drop_duplicates, dictionary)
    extra = [c for c in codes.columns if c != "code"] if isinstance(codes, DataFrame) else []
    df = df.withColumn("condition_start_date", F.to_date("condition_start_datetime"))
    visits = visits.select("visit_occurrence_id", "visit_occurrence_source_value", "care_site_id")
    df = df.join(visits, "visit_occurrence_id", "left")
    df = df.join(care_sites.select("care_site_id", "care_site_name"), "care_site_id", "left")
    return df.select(
        "person_id",
        "visit_occurrence_id",
        "condition_occurrence_id",
        "condition_start_date",
        "condition_source_value",
        "condition_status_source_value",
        "cdm_source",
        "visit_occurrence_source_value",
        "care_site_name",
        *extra,
    )


def select_notes(
    notes: DataFrame,
    concepts: int | Sequence[int] | DataFrame,
    columns: Sequence[str] = ("person_id", "note_date"),
    concept_column: str = "note_class_concept_id",
) -> DataFrame:
    """Notes whose class array holds a concept, any of a list, or joins a concept frame."""
    df = notes.select(*columns, concept_column)
    if isinstance(concepts, DataFrame):
        exploded = df.withColumn("_concept", F.explode(concept_column))
        return match_codes(exploded, concepts, "_concept", code="concept_id").drop("_concept").distinct()
    if isinstance(concepts, (list, tuple)):
        kind = df.schema[concept_column].dataType
        return df.filter(F.arrays_overlap(concept_column, F.array(*[F.lit(c) for c in concepts]).cast(kind)))
    return df.filter(F.array_contains(concept_column, concepts))


def eligible_notes(notes: DataFrame, note_class: str = NOTE_CLASS_MEETING, status: str = NOTE_STATUS_ACTIVE) -> DataFrame:
    """Active notes of the class with a text longer than the minimum."""
    return notes.filter(
        F.col("note_text").isNotNull()
        & (F.col("row_status_source_value") == status)
        & F.array_contains("note_class_source_value", note_class)
        & (F.length("note_text") > MIN_NOTE_LENGTH)
    )


def select_imaging(
    imaging: DataFrame,
    concepts: int | Sequence[int] | DataFrame,
    vocabulary: str = "DICOM",
    columns: Sequence[str] = ("person_id", "series_datetime"),
    convert_to_date: bool = True,
) -> DataFrame:
    if vocabulary not in MODALITY_COLUMNS:
        raise ValueError(f"vocabulary must be one of {sorted(MODALITY_COLUMNS)}")
    column = MODALITY_COLUMNS[vocabulary]
    df = imaging.select(*columns, column)
    codes = concepts.withColumnRenamed("concept_id", "code") if isinstance(concepts, DataFrame) else concepts
    df = filter_codes(df, codes, column)
    return df.withColumn("series_date", F.to_date("series_datetime")) if convert_to_date else df


def select_drugs(
    exposures: DataFrame,
    concepts: DataFrame,
    wanted: str | Sequence[str] | DataFrame,
    retrieve_by: str = "atc_code",
    vocabulary: str = "ATC",
    wanted_column: str = "ATC",
    fold: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Drug exposures whose concept has a wanted code, or a wanted first name part.

    Names are compared without case and accents unless `fold` is off. One row per concept is kept: the one
    with the smallest riding values.
    """
    if vocabulary != "ATC":
        raise ValueError("vocabulary must be 'ATC'")
    if retrieve_by not in ("atc_code", "name"):
        raise ValueError("retrieve_by must be either 'atc_code' or 'name'")
    named = retrieve_by == "name"

    def key(column):
        return fold_accents(column) if named and fold else F.col(column) if isinstance(column, str) else column

    lookup = key(first_part("concept_name")) if named else F.col("concept_code")
    known = concepts.filter(F.col("vocabulary_id") == vocabulary).select(
        "concept_id", "concept_code", "concept_name", lookup.alias("_lookup")
    )
    if isinstance(wanted, DataFrame):
        listed = wanted.withColumn("_wanted", key(wanted_column)).drop(wanted_column).distinct()
        found = match_codes(known, listed, "_lookup", code="_wanted")
    else:
        values = [wanted] if isinstance(wanted, (str, int)) else list(wanted)
        found = known.filter(F.col("_lookup").isin([key(F.lit(v)) if named and fold else v for v in values]))
    found = dedupe_on(found.drop("_lookup"), ["concept_id"]).withColumnRenamed("concept_id", "drug_class_concept_id")
    exposures = exposures if columns is None else exposures.select(*columns, "drug_class_concept_id")
    return exposures.join(found, "drug_class_concept_id", "inner")
