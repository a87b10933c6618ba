"""Votes of every labelling function on every span, and labels from votes."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from clinspark.functions.text import normalized_name, resolve_date
from clinspark.operators import label_models as lm
from clinspark.operators.groups import key_loads, spread_join, with_group_totals
from clinspark.operators.lfs import PatternLF, external_lfs, logical_lfs, pattern_voted_spans
from clinspark.operators.spans import DATE_PATTERNS, ContextWindow
from clinspark.operators.stored import stored
from clinspark.reference_values import KNOWLEDGE_LFS

TOKEN_CONTEXT = ContextWindow(words=(25, 25))


def apply_lfs(
    notes: DataFrame,
    events: DataFrame | None = None,
    patterns: Sequence[PatternLF] = (),
    rules: Sequence[Mapping] = (),
    span_patterns: Mapping[str, str] = DATE_PATTERNS,
    knowledge_lfs: Sequence[str] = KNOWLEDGE_LFS,
    threshold_days: int = 0,
    how: str = "inner",
    context: ContextWindow = TOKEN_CONTEXT,
    span_date: Column | None = None,
    known_lfs: Sequence[str] | None = None,
    keys: Sequence[str] = ("person_id", "note_id", "note_date"),
) -> DataFrame:
    """Notes -> one row per span with a column per labelling function and the span context.

    `events` are knowledge events (person_id, lf, event_date, class). With `how` = "inner" the spans of
    persons without events are dropped. Texts leave the plan at the span step; joins carry spans only. With events the
    dated spans are written to the shared folder, counted by person and by day, and spread by these counts.
    """
    names = [lf.name for lf in patterns] + [r["name"] for r in rules] + (list(knowledge_lfs) if events is not None else [])
    if known_lfs is not None and (unknown := [n for n in names if n not in known_lfs]):
        raise ValueError(f"labelling functions not in the reference: {unknown}")
    spans = pattern_voted_spans(notes, patterns, span_patterns, keys, contexts={"context": context})
    if events is not None:
        date = span_date if span_date is not None else resolve_date("lexical_variant", "note_date")
        dated = stored(spans.withColumn("span_date", date))
        if how == "inner":
            known = events.select("person_id").distinct().withColumn("_known", F.lit(True))
            dated = spread_join(dated, known, ["person_id"], key_loads(dated, ["person_id"])).filter("_known").drop("_known")
        spans = external_lfs(dated, events, knowledge_lfs, "span_date", threshold_days).drop("span_date")
    spans = logical_lfs(spans, rules)
    base = [*keys, "span_id", "lexical_variant", "label", "start", "end", "context"]
    return spans.select(*base, *[c for c in spans.columns if c not in base])


def task_matrices(
    votes: DataFrame, lfs_by_task: Mapping[str, Sequence[str]], negative: int, positive: int, abstention: int,
    multi_class_lfs: Sequence[str] = (), fillnone_as_negative: bool = True,
) -> DataFrame:
    """Votes plus one integer column `<task>:<lf>` per task and function."""
    columns = {}
    for task, lfs in lfs_by_task.items():
        for lf in lfs:
            kind = votes.schema[lf].dataType
            multi = lf in multi_class_lfs or isinstance(kind, T.ArrayType)
            fill = negative if fillnone_as_negative and not multi else abstention
            columns[f"{task}:{lf}"] = lm.vote_code(kind, lf, task, negative, positive, abstention, fill).cast("int")
    return votes.withColumns(columns)


def voting_notes(votes: DataFrame, lfs_by_task: Mapping[str, Sequence[str]], note: str = "note_id") -> tuple[DataFrame, dict[str, Column]]:
    """Per task, whether the note of a span has any vote for the task's functions; one pass for all tasks."""
    measures, names = {}, {}
    for i, (task, lfs) in enumerate(lfs_by_task.items()):
        voted = F.lit(False)
        for lf in lfs:
            array = isinstance(votes.schema[lf].dataType, T.ArrayType)
            voted = voted | (F.coalesce(F.array_contains(lf, task), F.lit(False)) if array else F.col(lf).isNotNull())
        measures[f"_voted_{i}"] = F.max(voted)
        names[task] = F.col(f"_voted_{i}")
    return with_group_totals(votes, [note], **measures), names


SPAN_COLUMNS = ("person_id", "instance_id", "span_id", "note_id", "lexical_variant", "label", "start", "end", "context")


@dataclass
class LabelRun:
    """Labels of the training spans, summaries of the functions, what the model does on the dev set, and its parameters."""

    labels: DataFrame
    summary_train: DataFrame
    summary_dev: DataFrame | None
    metrics: DataFrame  # one row per task
    shares: dict[str, float]
    accuracies: dict[str, dict[str, float]]


def label_tasks(
    votes: DataFrame,
    lfs_by_task: Mapping[str, Sequence[str]],
    method: str = "majority",
    shares: Mapping[str, float] | float = lm.DEFAULT_POSITIVE_SHARE,
    negative: int = 1,
    positive: int = 2,
    abstention: int = 0,
    avoid_all_abstentions: bool = True,
    fillnone_as_negative: bool = True,
    rescale: bool = False,
    keep: Sequence[str] = SPAN_COLUMNS,
) -> DataFrame:
    """Soft labels of all tasks: `<task>_0`, `<task>_1` and a map per task, on every span.

    Notes without votes are left out for fitting only. Fits and the rescaling (positive probabilities by their maximum where that is below
    one half) run on counted vote patterns; majority votes without rescaling need no pass before the last one.
    """
    codes = (negative, positive, abstention)
    matrix = task_matrices(votes, lfs_by_task, *codes, fillnone_as_negative=fillnone_as_negative)
    share_of = dict(shares) if isinstance(shares, Mapping) else dict.fromkeys(lfs_by_task, shares)
    if method not in lm.LABEL_MODELS:
        raise ValueError(f"label model must be one of {sorted(lm.LABEL_MODELS)}")
    patterns = None
    if rescale or method != "majority":
        patterns = stored(train_patterns(matrix, lfs_by_task, codes, avoid_all_abstentions and method != "majority"))
    fitted = fit_patterns(patterns, lfs_by_task, method, share_of)
    return labels_of(matrix, votes.columns, lfs_by_task, fitted, share_of, codes, patterns if rescale else None, keep)


def train_patterns(matrix: DataFrame, lfs_by_task, codes, avoid_all_abstentions: bool) -> DataFrame:
    """Counted vote patterns of all spans; `kept` are those of notes with votes, if the others are to be avoided."""
    kept = None
    if avoid_all_abstentions:
        matrix, kept = voting_notes(matrix, lfs_by_task)
    return lm.vote_patterns(matrix, lfs_by_task, codes[0], codes[1], kept)


def fit_patterns(patterns: DataFrame | None, lfs_by_task, method: str, shares: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """Fitted accuracies per task, a few numbers per function; none for majority votes."""
    if method == "majority":
        return {}
    fit = lm.triplet_fit_patterns(patterns, lfs_by_task) if method == "triplet" else lm.em_fit_patterns(patterns, lfs_by_task, shares)
    fitted: dict[str, dict[str, float]] = {task: {} for task in lfs_by_task}
    for row in fit.collect():
        fitted[row["task"]][row["lf"]] = row["accuracy"]
    return fitted


def scored_patterns(patterns: DataFrame, lfs_by_task, fitted, shares: Mapping[str, float]) -> DataFrame:
    """Patterns with `p`, the probability that the model gives them."""
    if not fitted:
        return lm.majority_of_patterns(patterns)
    return lm.with_parameters(patterns, {task: [fitted[task][lf] for lf in lfs] for task, lfs in lfs_by_task.items()}, shares)


def labels_of(matrix, columns, lfs_by_task, fitted, shares, codes, rescaled: DataFrame | None, keep) -> DataFrame:
    """Probability columns on every span; with `rescaled`, all patterns, those of a task below one half are divided by their maximum."""
    negative, positive, _ = codes
    tops = {}
    if rescaled is not None:
        scored = scored_patterns(rescaled, lfs_by_task, fitted, shares)
        tops = {r["task"]: r["top"] for r in scored.groupBy("task").agg(F.max("p").alias("top")).collect()}
    made = []
    for task, lfs in lfs_by_task.items():
        if fitted:
            p1 = lm.posterior(fitted[task], shares[task], negative, positive, prefix=f"{task}:")
        else:
            p1 = lm.majority_probs([f"{task}:{lf}" for lf in lfs], [negative, positive])[1]
        top = tops.get(task)
        if top is not None and 0 < top < 0.5:
            p1 = F.least(p1 / F.lit(top), F.lit(1.0))
        name = normalized_name(task)
        made += [(1 - p1).alias(f"{name}_0"), p1.alias(f"{name}_1"), F.create_map(F.lit("0"), 1 - p1, F.lit("1"), p1).alias(name)]
    return matrix.select(*[c for c in keep if c in columns], *made)


def label_pipeline(
    train: DataFrame,
    lfs_by_task: Mapping[str, Sequence[str]],
    dev: DataFrame | None = None,
    gold: Mapping[str, str] | None = None,
    method: str = "triplet",
    shares: Mapping[str, float] | float = lm.DEFAULT_POSITIVE_SHARE,
    min_support_dev: int = 15,
    negative: int = 1,
    positive: int = 2,
    abstention: int = 0,
    avoid_all_abstentions: bool = True,
    fillnone_as_negative: bool = True,
    rescale: bool = False,
    keep: Sequence[str] = SPAN_COLUMNS,
) -> LabelRun:
    """Votes of a training set and of a dev set with gold labels -> labels of the training spans and what is known about them.

    `gold` names the dev column of each task; a span counts as positive where it is true or 1. A task with at least `min_support_dev`
    positives there takes its share of positives from the dev set, else from `shares`. The models are fitted on the training notes with votes
    and judged on all dev spans; both sets are read once for their patterns, and the training set once more for its labels. `metrics`
    has per task: share, support, instances, precision, recall and fscore on the dev set (null without one), and the training spans with
    a probability of at least one half and below.
    """
    if method not in lm.LABEL_MODELS:
        raise ValueError(f"label model must be one of {sorted(lm.LABEL_MODELS)}")
    codes = (negative, positive, abstention)
    share_of = dict(shares) if isinstance(shares, Mapping) else dict.fromkeys(lfs_by_task, shares)
    matrix = task_matrices(train, lfs_by_task, *codes, fillnone_as_negative=fillnone_as_negative)
    patterns = stored(train_patterns(matrix, lfs_by_task, codes, avoid_all_abstentions))
    dev_patterns = None
    if dev is not None:
        if gold is None or set(gold) != set(lfs_by_task):
            raise ValueError("gold must name a dev column for each task")
        truth = {
            task: F.when(F.col(column).cast("string").isin("1", "true"), positive).otherwise(negative) for task, column in gold.items()
        }
        dev_matrix = task_matrices(dev, lfs_by_task, *codes, fillnone_as_negative=fillnone_as_negative)
        dev_patterns = stored(lm.vote_patterns(dev_matrix, lfs_by_task, negative, positive, gold=truth))
        balance = dev_patterns.groupBy("task").agg(F.sum(F.when(F.col("gold") == positive, F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("n"))
        for row in balance.collect():
            if row["k"] >= min_support_dev and row["n"] > row["k"]:
                share_of[row["task"]] = row["k"] / row["n"]
    fitted = fit_patterns(patterns, lfs_by_task, method, share_of)
    labels = labels_of(matrix, train.columns, lfs_by_task, fitted, share_of, codes, patterns if rescale else None, keep)
    scored = scored_patterns(patterns, lfs_by_task, fitted, share_of)
    top = F.max("p").over(Window.partitionBy("task"))
    if rescale:
        scored = scored.withColumn("_top", top).withColumn("p", F.when((F.col("_top") < 0.5) & (F.col("_top") > 0), F.col("p") / F.col("_top")).otherwise(F.col("p")))
    counted = scored.groupBy("task").agg(
        F.sum(F.when(F.col("p") >= 0.5, F.col("n")).otherwise(0)).alias("count_positives"),
        F.sum(F.when(F.col("p") < 0.5, F.col("n")).otherwise(0)).alias("count_negatives"),
    )
    session = train.sparkSession
    metrics = session.createDataFrame([(task, float(share_of[task])) for task in lfs_by_task], "task string, share double").join(counted, "task", "left")
    if dev_patterns is not None:
        judged = lm.pattern_metrics(scored_patterns(dev_patterns, lfs_by_task, fitted, share_of), positive)
    else:
        judged = session.createDataFrame([], "task string, support bigint, instances bigint, precision double, recall double, fscore double")
    metrics = metrics.join(judged, "task", "left")
    summary_train = lm.pattern_summary(patterns, lfs_by_task, negative, positive)
    summary_dev = lm.pattern_summary(dev_patterns, lfs_by_task, negative, positive, True) if dev_patterns is not None else None
    return LabelRun(labels, summary_train, summary_dev, metrics, share_of, fitted)


def rule_baseline(votes: DataFrame, task_of_lf: Mapping[str, str], keys: Sequence[str] = ("note_id", "start", "end", "label")) -> DataFrame:
    """Pattern votes as "1"/"0" predictions per task."""
    return votes.select(
        *keys, *[F.when(F.col(lf).isNotNull(), "1").otherwise("0").alias(normalized_name(task)) for lf, task in task_of_lf.items()]
    )
