"""Predicted spans as FHIR-shaped procedure rows."""

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from clinspark.functions.keys import joined_id, key_hash, prefixed_reference
from clinspark.functions.text import resolve_date
from clinspark.reference_values import SECURITY_CODE, SECURITY_DISPLAY, SECURITY_SYSTEM, SNOMED_SYSTEM


def predictions_long(pred: DataFrame, tasks: Sequence[str], probs: str | None = "prob", keep: Sequence[str] = ()) -> DataFrame:
    """One row per (span, task) predicted "1"; the score is read from the probability map of the task.

    `probs` is a map task -> map class -> probability.
    """
    base = ["note_id", "start", "end", "label", "lexical_variant", *keep]
    items = [F.struct(F.lit(t).alias("task_name"), F.col(t).cast("string").alias("value")) for t in tasks]
    chosen = F.filter(F.array(*items), lambda x: x["value"] == "1")
    rows = pred.select(*base, *([probs] if probs else []), F.explode(chosen).alias("_t"))
    score = F.col(probs)[F.col("_t.task_name")]["1"] if probs else F.lit(None).cast("double")
    return rows.select(*base, F.col("_t.task_name").alias("task_name"), score.alias("score"))


def scores_long(pred: DataFrame, tasks: Sequence[str], keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """One row per (span, task) whose probability column reaches the threshold."""
    items = [F.struct(F.lit(t).alias("task_name"), F.col(f"{t}_1").cast("double").alias("score")) for t in tasks]
    chosen = F.filter(F.array(*items), lambda x: x["score"] >= threshold)
    return pred.select(*keep, F.explode(chosen).alias("_t")).select(*keep, "_t.task_name", "_t.score")


def task_codings(tasks: DataFrame) -> DataFrame:
    """Coding of each task, by normalised name."""
    return tasks.select(
        F.col("normalized_task_name").alias("task_name"),
        F.col("SNOMED CT - SCTID").cast("string").alias("_code"),
        F.col("task").alias("_display"),
    )


def to_procedure(
    rows: DataFrame,
    tasks: DataFrame,
    status: str = "completed",
    default_day: int = 15,
    evidence: str | None = "context",
    mode: str | None = None,
    performed: Column | None = None,
) -> DataFrame:
    """Add a `procedure` struct built from a span, its note and the coding of its task.

    Rows hold note_id, person_id, note_date, start, end, label, lexical_variant, task_name and score.
    """
    coded = rows.join(task_codings(tasks), "task_name", "left")
    text = F.lit(None).cast("string")
    coding = F.struct(F.lit(SNOMED_SYSTEM).alias("system"), F.col("_code").alias("code"), F.col("_display").alias("display"))
    security = F.struct(
        F.lit(SECURITY_SYSTEM).alias("system"), F.lit(SECURITY_CODE).alias("code"), F.lit(SECURITY_DISPLAY).alias("display")
    )
    extension = F.struct(
        joined_id("note_id", "start", "end", "label", "task_name").alias("id"),
        text.alias("related_span"),
        F.struct(
            prefixed_reference("DocumentReference", text, "note_id").alias("reference"), F.col("note_id").alias("reference_id")
        ).alias("document_reference"),
        F.col("score").alias("model_confidence"),
        (F.col(evidence) if evidence else text).alias("text_evidence"),
        F.col("lexical_variant").alias("span_text"),
        F.col("start").alias("span_start"),
        F.col("end").alias("span_end"),
        F.struct((F.col(mode) if mode else text).alias("mode")).alias("attributes"),
        F.col("label").alias("span_label"),
    )
    when = performed if performed is not None else resolve_date("lexical_variant", "note_date", default_day)
    procedure = F.struct(
        F.lit("Procedure").alias("resourceType"),
        text.alias("id"),
        F.lit(status).alias("status"),
        F.struct(F.array(coding).alias("coding")).alias("code"),
        F.struct(
            prefixed_reference("Patient", text, "person_id").alias("reference"), F.col("person_id").alias("reference_id")
        ).alias("subject"),
        when.alias("performedDateTime"),
        F.struct(F.array(security).alias("security"), text.alias("source")).alias("meta"),
        text.alias("encounter"),
        F.array(extension).alias("extension_nlp"),
    )
    return coded.withColumn("procedure", procedure).drop("_code", "_display")


def _size_in_item(kind: T.DataType, name: str):
    return lambda item: dict(list_sizes(kind, item, ""))[name]


def list_sizes(kind: T.DataType, value: Column, prefix: str):
    """(name, largest size) pairs of the lists of a nested value, lists in lists included; null where there is none."""
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            yield from list_sizes(field.dataType, value[field.name], f"{prefix}__{field.name}" if prefix else field.name)
    elif isinstance(kind, T.ArrayType):
        yield prefix, F.when(value.isNotNull(), F.size(value))
        for name, _ in list_sizes(kind.elementType, F.get(value, F.lit(0)), ""):
            inner = F.array_max(F.transform(value, _size_in_item(kind.elementType, name)))
            # Every item of a list has its own names below it, and each is as wide as the widest.
            yield f"{prefix}___*__{name}" if name else f"{prefix}___*", inner


def measured_widths(df: DataFrame, column: str, widths: Mapping[str, int]) -> dict[str, int]:
    """Given widths, and for all other lists of the column the longest one of the data, at least 1: one aggregate."""
    sizes = dict(list_sizes(df.schema[column].dataType, F.col(column), ""))
    wanted = {n: e for n, e in sizes.items() if n not in widths}
    if not wanted:
        return dict(widths)
    row = df.agg(*[F.max(e).alias(f"w{i}") for i, e in enumerate(wanted.values())]).first()
    return dict(widths) | {n: max(1, row[i] or 0) for i, n in enumerate(wanted)}


def flatten_columns(kind: T.DataType, value: Column, prefix: str, widths: Mapping[str, int], default_width: int = 1):
    """(name, column) pairs of a nested type: a__b for fields, a___i for the items of a list; a longer list is an error."""
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            name = f"{prefix}__{field.name}" if prefix else field.name
            yield from flatten_columns(field.dataType, value[field.name], name, widths, default_width)
    elif isinstance(kind, T.ArrayType):
        width = widths.get(prefix, widths.get(re.sub(r"___\d+", "___*", prefix), default_width))
        if width == 0:
            yield prefix, value
        elif width > 0:
            message = F.lit(f"list {prefix} has more than {width} items")
            value = F.when(F.coalesce(F.size(value), F.lit(0)) <= width, value).otherwise(F.raise_error(message).cast(kind))
        for i in range(width):
            yield from flatten_columns(kind.elementType, F.get(value, F.lit(i)), f"{prefix}___{i}", widths, default_width)
    else:
        yield prefix, value


def flatten_struct(
    df: DataFrame, column: str, widths: Mapping[str, int] = {}, keep: Sequence[str] = (), resource_type: str | None = None,
    default_width: int | None = None,
) -> DataFrame:
    """Nested column -> flat columns; `resourceType` is added when it is not a field.

    A list gives as many columns as `widths` says (0: one column, the list itself), else `default_width`, else the length of the
    longest one, which one aggregate over the data finds. No item is lost: a list longer than a given width raises.
    """
    if default_width is None:
        widths = measured_widths(df, column, widths)
    pairs = list(flatten_columns(df.schema[column].dataType, F.col(column), "", widths, default_width or 1))
    columns = [c.alias(n) for n, c in pairs]
    if resource_type and "resourceType" not in [n for n, _ in pairs]:
        columns = [F.lit(resource_type).alias("resourceType"), *columns]
    return df.select(*keep, *columns)


def predictions_to_fhir(rows: DataFrame, tasks: DataFrame, model_name: str = "unknown_model", **options) -> DataFrame:
    """Flat procedure rows of scored spans, with the model as source and a stable id."""
    flat = flatten_struct(to_procedure(rows, tasks, **options), "procedure", default_width=1)  # its lists have one item
    flat = flat.withColumn("meta__source", F.lit(f"nlp_model_{model_name}"))
    flat = flat.drop("id", "encounter", "extension_nlp___0__related_span")
    ident = key_hash("procedure", "extension_nlp___0__id").alias("id")
    return flat.select(ident, "*")


