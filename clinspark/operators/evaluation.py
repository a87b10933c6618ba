"""Metrics of predictions against gold, agreement of annotators, metric tables."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clinspark.functions.text import nan_to_null, normalize_name
from clinspark.reference_values import AVERAGE_NAME, AVERAGED_MODELS, METRICS_TABLE_ORDER, TASK_SPECIFIC

BASE_COLS = ("note_id", "start", "end", "label")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def join_gold_pred(gold: DataFrame, pred: DataFrame, tasks: Sequence[str], keys: Sequence[str] = BASE_COLS) -> DataFrame:
    """Gold and predicted columns side by side on the span key (full outer); missing cells stay null."""
    left = gold.select(*keys, *[F.col(t).alias(f"{t}_gold") for t in tasks])
    right = pred.select(*keys, *[F.col(t).alias(f"{t}_pred") for t in tasks])
    return left.join(right, list(keys), "full")


def prf_rows(counts: DataFrame, tasks: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts (columns tp_i, fp_i, fn_i, tn_i, known_i, sup_i) -> one row per task and class."""
    rows = []
    for i, task in enumerate(tasks):
        tp, fp, fn, tn = (F.col(f"{c}_{i}") for c in ("tp", "fp", "fn", "tn"))
        empty = F.col(f"sup_{i}") == 0
        for label, (hit, extra, missed) in {"0": (tn, fn, fp), "1": (tp, fp, fn)}.items():
            precision, recall = _ratio(hit, hit + extra), _ratio(hit, hit + missed)
            fscore = _ratio(2 * hit, 2 * hit + extra + missed)
            zero = F.lit(0.0)
            rows.append(
                F.struct(
                    F.lit(task).alias("task"),
                    F.lit(label).alias("class"),
                    F.when(empty, zero).otherwise(precision).alias("precision"),
                    F.when(empty, zero).otherwise(recall).alias("recall"),
                    F.when(empty, zero).otherwise(fscore).alias("fscore"),
                    F.when(empty, F.lit(0).cast("bigint")).otherwise(hit + missed).alias("support"),
                    F.col(f"known_{i}").alias("n_instances"),
                )
            )
    return counts.select(*by, F.inline(F.array(*rows)))


def confusion_measures(tasks: Sequence[str], positive: str = "1") -> list[Column]:
    measures = []
    for i, task in enumerate(tasks):
        gold, pred = F.col(f"{task}_gold"), F.col(f"{task}_pred")
        g = F.coalesce(gold, F.lit("0")) == positive
        p = F.coalesce(pred, F.lit("0")) == positive
        measures += [
            F.count_if(g & p).alias(f"tp_{i}"),
            F.count_if(~g & p).alias(f"fp_{i}"),
            F.count_if(g & ~p).alias(f"fn_{i}"),
            F.count_if(~g & ~p).alias(f"tn_{i}"),
            F.count(gold).alias(f"known_{i}"),
            F.count_if(gold == positive).alias(f"sup_{i}"),
        ]
    return measures


def evaluate(gold: DataFrame, pred: DataFrame, tasks: Sequence[str], positive: str = "1", keys: Sequence[str] = BASE_COLS) -> DataFrame:
    """Precision, recall, F1 and support per task and class: one join and one aggregate for all tasks."""
    counts = join_gold_pred(gold, pred, tasks, keys).agg(*confusion_measures(tasks, positive))
    return prf_rows(counts, tasks)


def resolve_prediction_columns(columns: Sequence[str], tasks: Sequence[str], suffix: str | None) -> tuple[dict[str, str], list[str]]:
    """Prediction column of each task: suffix variants first, then the bare name; tasks without one are listed."""
    candidates = []
    if suffix:
        candidates = [suffix, suffix.lstrip("_")] if suffix.startswith("_") else [f"_{suffix}", suffix]
    found, skipped = {}, []
    for task in tasks:
        match = next((f"{task}{s}" for s in candidates if f"{task}{s}" in columns), task if task in columns else None)
        if match is None:
            skipped.append(task)
        else:
            found[task] = match
    return found, skipped


def prediction_frame(pred: DataFrame, tasks: Sequence[str], suffix: str | None = None, keys: Sequence[str] = BASE_COLS) -> tuple[DataFrame, list[str]]:
    """Predictions with one "0"/"1" column per task; booleans are encoded and missing votes are "0"."""
    missing = [k for k in keys if k not in pred.columns]
    if missing:
        raise ValueError(f"missing columns in predictions: {missing}")
    found, skipped = resolve_prediction_columns(pred.columns, tasks, suffix)

    def encoded(column):
        text = F.lower(F.col(column).cast("string"))
        return F.when(text == "true", "1").when(text == "false", "0").otherwise(F.coalesce(F.col(column).cast("string"), F.lit("0")))

    return pred.select(*keys, *[encoded(c).alias(t) for t, c in found.items()]), skipped


def evaluate_many(
    gold_sets: Mapping[str, DataFrame],
    predictions: Mapping[tuple[str, str], tuple[DataFrame, str | None]],
    tasks: Sequence[str],
    keys: Sequence[str] = BASE_COLS,
) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Many prediction sets, each {(model, dataset): (frame, suffix)}, -> tidy metrics and skipped tasks.

    All sets are stacked with their gold labels and grouped once on (set, span key): no join per set, and one pass over each frame. A
    span that a set or the gold labels hold twice counts once, with its largest labels.
    """
    skipped, known, stacked = [], {}, None
    users: dict[str, list[int]] = {}
    sets = list(predictions)

    def side(frame, columns, mark):
        values = [columns[t].alias(f"{t}_{mark}") if t in columns else F.lit(None).cast("string").alias(f"{t}_{mark}") for t in tasks]
        other = [F.lit(None).cast("string").alias(f"{t}_{'pred' if mark == 'gold' else 'gold'}") for t in tasks]
        return frame.select("_set", *keys, *values, *other, F.lit(mark == "gold").alias("_in_gold"))

    for i, (model, dataset) in enumerate(sets):
        frame, suffix = predictions[model, dataset]
        prepared, missing = prediction_frame(frame, tasks, suffix, keys)
        skipped += [(model, dataset, t) for t in missing]
        known[i] = [t for t in tasks if t not in missing]
        if not known[i]:
            continue
        users.setdefault(dataset, []).append(i)
        rows = side(prepared.withColumn("_set", F.lit(i)), {t: F.col(t).cast("string") for t in known[i]}, "pred")
        stacked = rows if stacked is None else stacked.unionByName(rows)
    if stacked is None:
        return None, skipped
    for dataset, numbers in users.items():
        gold = gold_sets[dataset].withColumn("_set", F.explode(F.array(*[F.lit(i) for i in numbers])))
        stacked = stacked.unionByName(side(gold, {t: F.col(t).cast("string") for t in tasks}, "gold"))
    marks = [f"{t}_{m}" for t in tasks for m in ("gold", "pred")]
    # Predictions on notes without gold labels don't count.
    spans = stacked.groupBy("_set", *keys).agg(*[F.max(m).alias(m) for m in marks])
    noted = stacked.filter("_in_gold").select("_set", "note_id").distinct()
    counts = spans.join(noted, ["_set", "note_id"], "left_semi").groupBy("_set").agg(*confusion_measures(tasks))
    names = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(d).alias("dataset"), F.array(*[F.lit(t) for t in known[i]]).cast("array<string>").alias("known")) for i, (m, d) in enumerate(sets)])
    rows = prf_rows(counts.withColumn("_name", F.get(names, F.col("_set"))), tasks, ["_name"])
    rows = rows.filter(F.array_contains(F.col("_name.known"), F.col("task")))
    return rows.select(F.col("_name.model").alias("model"), F.col("_name.dataset").alias("dataset"), *[c for c in rows.columns if c != "_name"]), skipped


# ---------------------------------------------------------------- agreement


def paired_annotations(first: DataFrame, second: DataFrame, tasks: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Labels of two annotators side by side on the notes both have annotated; missing labels are "0"."""
    common = first.select("note_id").distinct().join(second.select("note_id").distinct(), "note_id", "left_semi")
    a = first.join(common, "note_id", "left_semi").select(*keys, *[F.col(t).alias(f"{t}_a") for t in tasks])
    b = second.join(common, "note_id", "left_semi").select(*keys, *[F.col(t).alias(f"{t}_b") for t in tasks])
    return a.join(b, list(keys), "full").fillna("0", subset=[f"{t}_{s}" for t in tasks for s in "ab"])


def agreement(pairs: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Per task: Cohen's kappa, F1, discordances and positives of each annotator, from 2x2 counts."""
    measures = []
    for i, t in enumerate(tasks):
        a, b = F.col(f"{t}_a") == "1", F.col(f"{t}_b") == "1"
        measures += [
            F.count_if(a & b).alias(f"both_{i}"),
            F.count_if(a & ~b).alias(f"a_{i}"),
            F.count_if(~a & b).alias(f"b_{i}"),
            F.count_if(~a & ~b).alias(f"none_{i}"),
        ]
    one = pairs.agg(*measures)
    rows = []
    for i, t in enumerate(tasks):
        both, only_a, only_b, none = (F.col(f"{c}_{i}").cast("double") for c in ("both", "a", "b", "none"))
        n = both + only_a + only_b + none
        observed = (both + none) / n
        expected = ((both + only_a) * (both + only_b) + (none + only_a) * (none + only_b)) / (n * n)
        rows.append(
            F.struct(
                F.lit(t).alias("task"),
                F.when((n > 0) & (expected < 1), (observed - expected) / (1 - expected)).alias("kappa"),
                _ratio(2 * both, 2 * both + only_a + only_b).alias("f1"),
                (only_a + only_b).cast("bigint").alias("n_discordances"),
                (both + only_a).cast("bigint").alias("n_positive_a"),
                (both + only_b).cast("bigint").alias("n_positive_b"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def discordances(pairs: DataFrame, tasks: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per span and task on which the two annotators differ."""
    items = [F.struct(F.lit(t).alias("task"), F.col(f"{t}_a").alias("label_a"), F.col(f"{t}_b").alias("label_b")) for t in tasks]
    differing = F.filter(F.array(*items), lambda x: x["label_a"] != x["label_b"])
    rows = pairs.select(*keys, F.explode(differing).alias("_d"))
    return rows.select(*keys, "_d.task", "_d.label_a", "_d.label_b")


def task_stats(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Counts of "0" and "1" per task; a class that never occurs counts zero."""
    measures = [F.count_if(F.col(t) == v).alias(f"n{v}_{i}") for i, t in enumerate(tasks) for v in "01"]
    rows = [
        F.struct(F.lit(i + 1).alias("task_id"), F.lit(t).alias("task"), F.col(f"n0_{i}").alias("n_0"), F.col(f"n1_{i}").alias("n_1"))
        for i, t in enumerate(tasks)
    ]
    return df.agg(*measures).select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- metric tables


def filter_models(models: DataFrame, only_active: bool = True, name_codes: Sequence[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    if only_active:
        models = models.filter(F.lower(F.col("active").cast("string")).isin("1", "1.0", "true"))
    if name_codes is not None:
        models = models.filter(F.col("name_code").isin(list(name_codes)))
    if types is not None:
        models = models.filter(F.col("type").isin(list(types)))
    return models


def latest_metrics(metrics: DataFrame, stamp: str = "produced_at") -> DataFrame:
    """Rows of the newest result of each (model, name code, dataset)."""
    keys = ["model_id", "name_code", "dataset"]
    newest = metrics.groupBy(*keys).agg(F.max(stamp).alias(stamp))
    return metrics.join(newest, [*keys, stamp], "left_semi")


def one_model_per_name(models: DataFrame) -> DataFrame:
    """The same models; the job stops when a display name belongs to two of them, unless they are task-specific ones."""
    same_name = Window.partitionBy("name_display")
    general = F.lower(F.trim("name_display")) != TASK_SPECIFIC
    known = F.col("name_display").isNotNull() & F.col("id").isNotNull() & F.col("name_code").isNotNull()
    ids = F.when(known, F.col("id"))
    repeated = F.raise_error(F.concat(F.lit("duplicate name_display: "), F.col("name_display"))).cast("boolean")
    marked = models.withColumns({"_least": F.min(ids).over(same_name), "_most": F.max(ids).over(same_name)})
    return marked.filter(F.when(known & general & (F.col("_least") != F.col("_most")), repeated).otherwise(F.lit(True))).drop("_least", "_most")


def shown_metrics(models: DataFrame, metrics: DataFrame, tasks: DataFrame) -> DataFrame:
    """Positive-class metrics of the models to show; a task-specific model only fills its own task."""
    named = models.dropna(subset=["id", "name_display", "name_code"]).select(
        F.col("id").alias("model_id"), "name_code", "name_display", "task_name"
    )
    rows = latest_metrics(metrics).filter(F.col("class") == "1").join(named, ["model_id", "name_code"])
    specific = F.lower(F.trim("name_display")) == TASK_SPECIFIC
    own_task = F.col("task") == normalize_name("task_name")
    rows = rows.filter(~specific | F.col("task_name").isNull() | own_task)
    return rows.join(tasks.select(F.col("normalized_task_name").alias("task")), "task", "left_semi")


def metrics_table(
    models: DataFrame,
    metrics: DataFrame,
    tasks: DataFrame,
    names: Sequence[str],
    measures: Sequence[str] = ("fscore",),
    datasets: Sequence[str] = ("A", "B"),
    check: bool = True,
) -> DataFrame:
    """Tasks as rows; support per dataset, then one column per (model, dataset[, metric]) in the fixed order.

    `names` are the display names to show; names outside the fixed order come last. With `check` the job stops on a display name of two
    models and on supports of a task and dataset that differ between models; both are part of the one aggregate that makes the table.
    """
    shown = shown_metrics(one_model_per_name(models) if check else models, metrics, tasks)

    def title(name, dataset, measure):
        return f"{name}|{dataset}|{measure}" if len(measures) > 1 else f"{name}|{dataset}"

    cells = []
    for d in datasets:
        support = F.when(F.col("dataset") == d, F.col("support"))
        most = F.max(support)
        if check:
            message = F.concat(F.lit("support mismatch for task "), F.col("task"), F.lit(f" dataset {d}"))
            most = F.when(F.min(support) != most, F.raise_error(message).cast(shown.schema["support"].dataType)).otherwise(most)
        cells.append(most.alias(f"Support|{d}"))
    for name in names:
        for d in datasets:
            here = (F.col("name_display") == name) & (F.col("dataset") == d)
            cells += [F.max(F.when(here, F.col(m))).alias(title(name, d, m)) for m in measures]
    wide = shown.groupBy("task").agg(*cells)
    table = tasks.select("task_id", "snomed_short_name", F.col("normalized_task_name").alias("task")).join(wide, "task", "left")
    order = [n for n in METRICS_TABLE_ORDER if n in names or n == AVERAGE_NAME]
    order += [n for n in names if n not in order]
    averaged = all(n in names for n in AVERAGED_MODELS)
    columns = [F.col("task_id").alias("Task id"), F.col("snomed_short_name").alias("Task (Procedure)")]
    columns += [F.col(f"`Support|{d}`") for d in datasets]
    for name in order:
        if name == AVERAGE_NAME and name not in names:
            if averaged:
                a, b = AVERAGED_MODELS
                columns += [
                    ((F.col(f"`{title(a, d, m)}`") + F.col(f"`{title(b, d, m)}`")) / 2).alias(title(name, d, m))
                    for d in datasets
                    for m in measures
                ]
            continue
        columns += [F.col(f"`{title(name, d, m)}`") for d in datasets for m in measures]
    return table.select("task", *columns).orderBy("Task id")


def metric_stats(tidy: DataFrame, value: str = "fscore", by: Sequence[str] = ("name_display", "dataset"), minimum_support: int = 5) -> DataFrame:
    """Spread of a metric over tasks, per model and dataset; tasks below the support are masked."""
    v = F.when(F.col("support") >= minimum_support, F.col(value))
    return tidy.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.percentile(v, F.lit(0.25)).alias("q25"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.percentile(v, F.lit(0.75)).alias("q75"),
        F.when(F.avg(v) != 0, F.stddev_samp(v) / F.avg(v)).alias("cv"),
    )


def clean_metrics(metrics: DataFrame, columns: Sequence[str] = ("precision", "recall", "fscore")) -> DataFrame:
    """NaN metrics become null before they are written as JSON."""
    return metrics.withColumns({c: nan_to_null(c) for c in columns})
