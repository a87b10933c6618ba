"""Small reference tables: tasks, labelling functions, code lists, oncology drugs."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clinspark.functions.text import fold_accents, normalize_name
from clinspark.operators.groups import unique_by
from clinspark.operators.vocabulary import CHUNK, regex_chunks
from clinspark.reference_values import DRUG_NAME_COLUMNS, TREATMENT_SCTIDS


def read_tasks(raw: DataFrame) -> DataFrame:
    """Task sheet -> task dimension with its normalised name."""
    renamed = raw.withColumnsRenamed({"Task Number": "task_id", "SNOMED CT - Fully Specified Name (FSN)": "task"})
    return renamed.withColumn("normalized_task_name", normalize_name("task"))


def read_lf_reference(raw: DataFrame, tasks: DataFrame, implemented: str | None = "ok") -> tuple[DataFrame, DataFrame]:
    """Labelling functions with the name of their task, and their distinct names; a task id of two tasks stops the job."""
    rows = raw if implemented is None else raw.filter(F.col("Implemented") == implemented)
    rows = rows.select("Task Number", "ref_name", "LF type")
    names = rows.select("ref_name").distinct()
    tasks = unique_by(tasks.select("task_id", "normalized_task_name"), ["task_id"], "tasks")
    return rows.join(tasks, rows["Task Number"] == tasks["task_id"], "left"), names


def read_localisations(raw: DataFrame) -> DataFrame:
    """Localisation list -> (code, system, organ)."""
    return raw.select(F.col("diag").alias("code"), F.col("Appareil").alias("system"), F.col("Organe").alias("organ"))


def knowledge_codes(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """Code sheets by kind (procedures, diagnoses, notes, imaging) -> (kind, code, task_id)."""
    out = None
    for kind, sheet in sheets.items():
        code = next(c for c in ("Code", "code", "concept_id") if c in sheet.columns)
        rows = sheet.select(F.lit(kind).alias("kind"), F.col(code).cast("string").alias("code"), F.col("Task Number").alias("task_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def treatment_sctid(column: str) -> Column:
    pairs = [F.lit(x) for name, sctid in TREATMENT_SCTIDS.items() for x in (name, sctid)]
    return F.create_map(*pairs)[F.col(column)]


def oncology_drugs(raw: DataFrame, treatments: Sequence[str] | None = tuple(TREATMENT_SCTIDS)) -> DataFrame:
    """Drug list with folded names, treatment type and its SNOMED CT id; unknown types have no id."""
    df = raw.withColumnRenamed("macro_class", "treatement_type")
    df = df.withColumns({new: fold_accents(old) for old, new in DRUG_NAME_COLUMNS.values() if old in df.columns})
    df = df.withColumn("SNOMED CT - SCTID", treatment_sctid("treatement_type"))
    return df if treatments is None else df.filter(F.col("treatement_type").isin(list(treatments)))


def drug_names(drugs: DataFrame, label_types: Sequence[str] = tuple(DRUG_NAME_COLUMNS)) -> DataFrame:
    """(treatement_type, label_type, name): the distinct names as rows, `all` included on both sides."""
    long = drugs.select(
        "treatement_type",
        F.inline(F.array(*[F.struct(F.lit(t).alias("label_type"), F.col(DRUG_NAME_COLUMNS[t][1]).alias("name")) for t in label_types])),
    ).filter(F.col("name").isNotNull())
    copies = F.array(
        F.struct("treatement_type", "label_type"),
        F.struct("treatement_type", F.lit("all").alias("label_type")),
        F.struct(F.lit("all").alias("treatement_type"), F.lit("all").alias("label_type")),
    )
    return long.select("name", F.inline(copies)).distinct().select("treatement_type", "label_type", "name")


def drug_vocab(drugs: DataFrame, label_types: Sequence[str] = tuple(DRUG_NAME_COLUMNS), chunk: int = CHUNK) -> DataFrame:
    """Names and an alternation regex per treatment type, label type and chunk of names."""
    return regex_chunks(drug_names(drugs, label_types), ["treatement_type", "label_type"], chunk=chunk)
