"""Annotation folders and snapshots."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clinspark.schemas import SNAPSHOT, SNAPSHOT_NOTE


def _stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), r"\.(txt|json)$", "")


def read_annotation_folder(spark: SparkSession, path: str, doc_schema=None, patient_schema=None) -> tuple[DataFrame, DataFrame]:
    """One folder per patient with metadata.json and pairs of .txt and .json per note -> notes, patients.

    A JSON file that cannot be read raises. Spark's readers leave out files without a byte, so a note with an empty text is missing here;
    the `AnnotationFolder` source has it.
    """
    fields = [f for f in SNAPSHOT_NOTE.fields if f.name != "note_text"]
    base = path.rstrip("/") + "/*"
    strict = {"multiLine": True, "mode": "FAILFAST"}
    docs = spark.read.schema(doc_schema or T.StructType(fields)).options(**strict).json(f"{base}/*.json")
    docs = docs.withColumn("_stem", _stem()).filter(~F.col("_stem").endswith("/metadata"))
    texts = spark.read.text(f"{base}/*.txt", wholetext=True).select(F.col("value").alias("note_text"), _stem().alias("_stem"))
    reader = spark.read.options(**strict)
    patients = (reader.schema(patient_schema) if patient_schema else reader).json(f"{base}/metadata.json")
    return texts.join(docs, "_stem", "inner").drop("_stem"), patients


def read_snapshots(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Snapshots by annotator -> (notes, annotator) rows."""
    out = None
    for annotator, path in paths.items():
        rows = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).withColumn("annotator", F.lit(annotator))
        out = rows if out is None else out.unionByName(rows)
    return out
