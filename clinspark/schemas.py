"""Column contracts of the public inputs."""

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_long, _int, _str, _ts, _date = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType(), T.DateType()

CONDITION = _schema(
    person_id=_long,
    visit_occurrence_id=_long,
    condition_occurrence_id=_str,
    condition_start_datetime=_ts,
    condition_source_value=_str,
    condition_status_source_value=_str,
    cdm_source=_str,
)
PROCEDURE = _schema(
    person_id=_long,
    visit_occurrence_id=_long,
    procedure_occurrence_id=_str,
    procedure_datetime=_ts,
    procedure_source_value=_str,
    cdm_source=_str,
)
COST = _schema(cost_id=_long, cost_event_id=_long, drg_source_value=_str, cdm_source=_str)
VISIT = _schema(
    visit_occurrence_id=_long,
    person_id=_long,
    visit_start_datetime=_ts,
    visit_end_datetime=_ts,
    visit_source_value=_str,
    visit_occurrence_source_value=_str,
    care_site_id=_long,
)
CARE_SITE = _schema(care_site_id=_long, care_site_name=_str)
CONCEPT = _schema(concept_id=_long, concept_code=_str, concept_name=_str, vocabulary_id=_str)
DRUG_EXPOSURE = _schema(
    person_id=_long,
    drug_exposure_start_date=_date,
    drug_class_source_value=_str,
    drug_ucd_source_value=_str,
    drug_source_value=_str,
    drug_class_concept_id=_long,
)
IMAGING_SERIES = _schema(
    person_id=_long, series_datetime=_ts, modality_concept_id=_long, modality_source_concept_id=_long
)
NOTE = _schema(
    person_id=_long,
    note_id=_long,
    visit_occurrence_id=_long,
    care_site_id=_long,
    note_date=_date,
    note_datetime=_ts,
    note_class_source_value=T.ArrayType(_str),
    note_class_concept_id=T.ArrayType(_long),
    note_title=_str,
    note_text=_str,
    row_status_source_value=_str,
)
TASK = T.StructType(
    [
        T.StructField("task_id", _int),
        T.StructField("task", _str),
        T.StructField("normalized_task_name", _str),
        T.StructField("Task Name (date de)", _str),
        T.StructField("snomed_short_name", _str),
        T.StructField("SNOMED CT - SCTID", _long),
        T.StructField("Group", _int),
    ]
)
ENTITY = T.StructType(
    [
        T.StructField("id", _str),
        T.StructField("text", _str),
        T.StructField("label", _str),
        T.StructField("begin", _int),
        T.StructField("end", _int),
    ]
)
SNAPSHOT_NOTE = T.StructType(
    [
        T.StructField("note_id", _str),
        T.StructField("person_id", _str),
        T.StructField("note_date", _str),
        T.StructField("note_text", _str),
        T.StructField("annotation_order", _long),
        T.StructField("seen", T.BooleanType()),
        T.StructField("entities", T.ArrayType(ENTITY)),
    ]
)
SNAPSHOT = T.StructType([T.StructField("notes", T.ArrayType(SNAPSHOT_NOTE))])

TABLES = {
    "condition": CONDITION,
    "procedure": PROCEDURE,
    "cost": COST,
    "visit_occurrence": VISIT,
    "care_site": CARE_SITE,
    "concept": CONCEPT,
    "drug_exposure_administration": DRUG_EXPOSURE,
    "drug_exposure_prescription": DRUG_EXPOSURE,
    "imaging_series": IMAGING_SERIES,
    "note": NOTE,
}
