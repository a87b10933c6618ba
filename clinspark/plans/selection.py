"""Choosing training spans and building the training sets."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from clinspark.functions.text import normalized_name
from clinspark.operators.datasets import build_dataset, dataset_card, merge_tasks
from clinspark.operators.sampling import add_instance_id, oversample, sample_n, sample_negatives, threshold_flags
from clinspark.operators.stored import stored
from clinspark.reference_values import PROXIMITY_SCALE

SPAN_COLUMNS = ("note_id", "start", "end", "lexical_variant")


def select_training_data(
    labels: DataFrame,
    task: str,
    keys: Sequence[str] = ("span_id",),
    max_positives: int | None = 1000,
    thresholds: tuple[float, float] = (0.5, 0.5),
    ratio: float | None = 1.0,
    strategy: str | None = "subsampling",
    seed=123,
    negative_seed=0,
    scale: float = PROXIMITY_SCALE,
    use_weight: bool = True,
    only_notes_with_positives: bool = True,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Positive and negative spans of one task with `is_positive` and an instance id.

    Subsampling keeps ratio x positives negatives; oversampling draws positives up to ratio x negatives;
    without a strategy every span outside the gap between the thresholds is kept.

    The labels are read once: what is chosen by, and `extra`, is written to the shared folder, and every pass of the samples reads that.
    """
    prob = f"{normalized_name(task)}_1"
    columns = [*dict.fromkeys([*keys, *SPAN_COLUMNS, *extra])]
    labels = stored(labels.select(*dict.fromkeys([*columns, prob])))
    flagged = threshold_flags(labels, prob, thresholds)
    positives = flagged.filter("is_positive")
    if max_positives is not None:
        positives = sample_n(positives, max_positives, keys, seed)
    n_negatives = None
    if ratio is not None and strategy == "subsampling":
        n_negatives = positives.agg(F.floor(F.count(F.lit(1)) * F.lit(float(ratio)))).scalar()
    negatives = sample_negatives(
        labels, prob, n_negatives, keys, negative_seed, scale, use_weight, only_notes_with_positives, thresholds
    )
    positives = positives.select(*columns, F.lit(0).cast("bigint").alias("draw"))
    if ratio is not None and strategy == "oversampling":
        wanted = negatives.agg(F.floor(F.count(F.lit(1)) * F.lit(float(ratio)))).scalar()
        positives = oversample(positives.drop("draw"), wanted, keys, seed)
    stacked = positives.withColumn("is_positive", F.lit(True)).unionByName(
        negatives.select(*columns, F.lit(0).cast("bigint").alias("draw")).withColumn("is_positive", F.lit(False))
    )
    return add_instance_id(stacked, [*keys, "draw"])


def task_dataset(labels: DataFrame, notes: DataFrame, task: str, **options) -> tuple[DataFrame, DataFrame]:
    """Training set of one task and its card, from labels as `label_tasks` makes them."""
    name = normalized_name(task)
    chosen = stored(select_training_data(labels, task, extra=(name,), **options))
    dataset = build_dataset(notes, chosen, attributes=(name, "instance_id"), span_label=f"train_{name}", draw="draw")
    return dataset, dataset_card(chosen, "is_positive")


def build_multitask_dataset(
    labels: Mapping[str, DataFrame], notes: DataFrame | None, keys: Sequence[str], suffix: str | None = None, span_label: str = "train_date"
) -> tuple[DataFrame, DataFrame]:
    """Spans of all tasks in one training set (or the merged spans alone, without notes), and the card."""
    merged = add_instance_id(merge_tasks(labels, keys, suffix), list(keys))
    card = dataset_card(merged)
    if notes is None:
        return merged, card
    return build_dataset(notes, merged, attributes=(*labels, "instance_id"), span_label=span_label), card
