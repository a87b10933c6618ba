"""Scored spans to prediction rows or FHIR rows."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from clinspark.operators.fhir import predictions_long, predictions_to_fhir, scores_long
from clinspark.operators.spans import DATE_PATTERNS, ContextWindow, extract_spans


def score_spans(spans: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], tasks: Sequence[str]) -> DataFrame:
    """Add `<task>_1` probabilities from a caller-supplied batch function over span rows."""
    schema = T.StructType([*spans.schema.fields, *[T.StructField(f"{t}_1", T.DoubleType()) for t in tasks]])
    names = [f"{t}_1" for t in tasks]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = scorer(batch)
            yield batch.assign(**{n: scores[n].to_numpy() for n in names})

    return spans.mapInPandas(run, schema)


def infer(
    notes: DataFrame,
    scorer: Callable[[pd.DataFrame], pd.DataFrame],
    tasks: Sequence[str],
    task_dimension: DataFrame | None = None,
    model_name: str = "unknown_model",
    export_to_fhir: bool = True,
    long_format: bool = False,
    context: ContextWindow = ContextWindow(words=(25, 25)),
    threshold: float = 0.5,
) -> DataFrame:
    """Notes -> spans -> scores -> FHIR rows, long rows or one row per span."""
    spans = extract_spans(notes, DATE_PATTERNS, keys=("person_id", "note_id", "note_date"), contexts={"context": context})
    scored = score_spans(spans, scorer, tasks)
    keep = ["person_id", "note_id", "note_date", "start", "end", "label", "lexical_variant", "context"]
    if export_to_fhir:
        return predictions_to_fhir(scores_long(scored, tasks, keep, threshold), task_dimension, model_name)
    hard = scored.withColumns({t: F.when(F.col(f"{t}_1") >= threshold, "1").otherwise("0") for t in tasks})
    if not long_format:
        return hard
    probs = F.create_map(
        *[x for t in tasks for x in (F.lit(t), F.create_map(F.lit("0"), 1 - F.col(f"{t}_1"), F.lit("1"), F.col(f"{t}_1")))]
    )
    return predictions_long(hard.withColumn("prob", probs), tasks, keep=["context"])
