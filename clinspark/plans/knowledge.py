"""External knowledge: coded events of a set of persons, per labelling function."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from clinspark.operators.codes import filter_persons, filter_source, match_codes
from clinspark.operators.events import select_conditions, select_drugs, select_imaging, select_notes
from clinspark.operators.groups import unique_by
from clinspark.reference_values import KNOWLEDGE_LFS


def clean_dates(events: DataFrame, column: str = "event_date") -> DataFrame:
    """Event date as a date; rows without a valid one are dropped."""
    kind = dict(events.dtypes)[column]
    value = F.try_to_timestamp(F.col(column)).cast("date") if kind == "string" else F.col(column).cast("date")
    return events.withColumn(column, value).filter(F.col(column).isNotNull())


def tag_events(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Stack (person_id, event_date, task_id) rows of each labelling function with its name."""
    out = None
    for lf, rows in sources.items():
        tagged = rows.select("person_id", "event_date", "task_id").withColumn("lf", F.lit(lf))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def drug_events(
    administrations: DataFrame, prescriptions: DataFrame, concepts: DataFrame, drugs: DataFrame, tasks: DataFrame,
    fold: bool = True,
) -> DataFrame:
    """Drug exposures found by code or by name in both tables, as events of the task of their treatment."""
    out = None
    for table in (administrations, prescriptions):
        for how, column in (("atc_code", "ATC"), ("name", "normalized_atc")):
            wanted = drugs.select(column, "SNOMED CT - SCTID")
            rows = select_drugs(table, concepts, wanted, how, wanted_column=column, fold=fold)
            rows = rows.select("person_id", F.col("drug_exposure_start_date").alias("event_date"), "SNOMED CT - SCTID")
            out = rows if out is None else out.unionByName(rows)
    sctids = tasks.select("task_id", "SNOMED CT - SCTID")
    return out.distinct().join(sctids, "SNOMED CT - SCTID").select("person_id", "event_date", "task_id")


def knowledge_events(
    persons: DataFrame | None,
    tasks: DataFrame,
    procedures: DataFrame,
    conditions: DataFrame,
    notes: DataFrame,
    imaging: DataFrame,
    drug_rows: DataFrame | None,
    procedure_codes: DataFrame,
    condition_codes: DataFrame,
    note_concepts: DataFrame,
    imaging_concepts: DataFrame,
    claim_source: str | None = None,
    sources: Mapping[str, str] = {},
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Distinct (person_id, lf, event_date, class) rows of the five knowledge functions.

    Code frames hold `code` (or `concept_id`) and `task_id`. Only ids, dates and codes of the event tables
    are read; persons are restricted before rows are made distinct. `dictionary` are the diagnosis codes in use, if known.
    """
    acts = match_codes(filter_source(procedures, claim_source, sources), procedure_codes, "procedure_source_value")
    diagnoses = select_conditions(filter_source(conditions, claim_source, sources), condition_codes, dictionary=dictionary)
    images = None
    for vocabulary in ("DICOM", "SOURCE"):
        rows = select_imaging(imaging, imaging_concepts, vocabulary).select("person_id", "series_date", "task_id")
        images = rows if images is None else images.unionByName(rows)
    found = {
        "lf_ccam": acts.select("person_id", F.to_date("procedure_datetime").alias("event_date"), "task_id"),
        "lf_icd10": diagnoses.select("person_id", F.to_date("condition_start_datetime").alias("event_date"), "task_id"),
        "lf_note_md": select_notes(notes, note_concepts).select("person_id", F.col("note_date").alias("event_date"), "task_id"),
        "lf_imaging_md": images.select("person_id", F.col("series_date").alias("event_date"), "task_id"),
    }
    if drug_rows is not None:
        found["lf_drugs"] = drug_rows
    events = clean_dates(filter_persons(tag_events(found), persons)).distinct()
    names = unique_by(tasks.select("task_id", F.col("task").alias("class")), ["task_id"], "tasks")
    return with_task_names(events.join(names, "task_id", "left")).select("person_id", "lf", "event_date", "class")


def with_task_names(events: DataFrame) -> DataFrame:
    """The same events; the job stops at one whose task has no name."""
    message = F.concat(F.lit("event without a task name: task "), F.coalesce(F.col("task_id").cast("string"), F.lit("null")))
    return events.withColumn("class", F.when(F.col("class").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("class")))


def collect_events(events: DataFrame) -> DataFrame:
    """(person_id, lf, events): distinct {value, class} per person and function, ordered by date.

    The array of a person holds at most days x tasks values, because repeats are removed before collecting.
    """
    item = F.struct(F.col("event_date").alias("value"), "class")
    return events.groupBy("person_id", "lf").agg(F.sort_array(F.collect_set(item)).alias("events"))


def external_knowledge(events: DataFrame, lfs: Sequence[str] = KNOWLEDGE_LFS) -> DataFrame:
    """One row per person with one event array per function; a function without events is null."""
    item = F.struct(F.col("event_date").alias("value"), "class")
    columns = [F.collect_set(F.when(F.col("lf") == lf, item)).alias(lf) for lf in lfs]
    wide = events.groupBy("person_id").agg(*columns)
    return wide.select("person_id", *[F.when(F.size(lf) > 0, F.sort_array(lf)).alias(lf) for lf in lfs])
