"""Human annotations: overlap with detected spans, annotator choice, label hierarchy."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from clinspark.functions.keys import joined_id
from clinspark.functions.text import char_context, encode_labels
from clinspark.operators.groups import dedupe_on, unique_by, with_group_totals

# Offsets are cut into blocks of this many characters; the offsets of a block fit the bits of a long.
BLOCK = 60


def _blocks(df: DataFrame) -> DataFrame:
    """One row per (span, block of offsets), with the touched offsets of the block as a bit mask."""
    first, last = F.floor(F.col("begin") / BLOCK), F.floor(F.col("end") / BLOCK)
    rows = df.withColumn("_block", F.explode(F.sequence(first, last)))
    low = (F.greatest(F.col("begin"), F.col("_block") * BLOCK) - F.col("_block") * BLOCK).cast("int")
    high = (F.least(F.col("end"), F.col("_block") * BLOCK + BLOCK - 1) - F.col("_block") * BLOCK).cast("int")
    mask = F.expr("shiftleft(shiftleft(1L, _high - _low + 1) - 1L, _low)")
    return rows.withColumn("_low", low).withColumn("_high", high).withColumn("_mask", mask).drop("_low", "_high")


def overlap_spans(highlights: DataFrame, dates: DataFrame) -> DataFrame:
    """(note_id, begin, end, label): detected spans that touch a highlight, closed at both ends, without repeats.

    Highlights are first merged into one bit mask per note, block and label, so a span meets each label at
    most once per block and no pair of spans is ever listed.
    """
    covered = (
        _blocks(highlights.select("note_id", "label", "begin", "end"))
        .groupBy("note_id", "_block", "label")
        .agg(F.bit_or("_mask").alias("_covered"))
    )
    spans = _blocks(dates.select("note_id", "begin", "end").distinct())
    hits = spans.join(covered, ["note_id", "_block"]).filter(F.col("_mask").bitwiseAND(F.col("_covered")) != 0)
    return hits.select("begin", "end", "label", "note_id").distinct()


def prefer_annotator(notes: DataFrame, priority: Sequence[str], note: str = "note_id", annotator: str = "annotator") -> DataFrame:
    """Rows of the preferred annotator of each note; unlisted names come last, then by name."""
    rank = F.lit(len(priority))
    for i, name in reversed(list(enumerate(priority))):
        rank = F.when(F.col(annotator) == name, F.lit(i)).otherwise(rank)
    best = with_group_totals(notes, [note], _best=F.min(F.struct(rank.alias("rank"), F.col(annotator).alias("name"))))
    return best.filter(F.col(annotator).eqNullSafe(F.col("_best.name"))).drop("_best")


def preferred_annotators(documents: DataFrame, priority: Sequence[str]) -> DataFrame:
    """(note_id, annotator) chosen for each note: one row per note."""
    rank = F.lit(len(priority))
    for i, name in reversed(list(enumerate(priority))):
        rank = F.when(F.col("annotator") == name, F.lit(i)).otherwise(rank)
    best = documents.groupBy("note_id").agg(F.min(F.struct(rank.alias("rank"), "annotator")).alias("_best"))
    return best.select("note_id", F.col("_best.annotator").alias("annotator"))


def annotators_per_note(documents: DataFrame) -> DataFrame:
    return documents.groupBy("note_id").agg(F.count_distinct("annotator").alias("n_annotators"))


def pivot_labels(overlaps: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("note_id", "begin", "end")) -> DataFrame:
    """One row per span and one boolean column per known label; labels that never occur are false."""
    flags = overlaps.groupBy(*keys).pivot("label", list(labels)).agg(F.max(F.lit(True)))
    return flags.fillna(False, subset=list(labels))


def propagate_labels(flags: DataFrame, rules: Sequence[tuple[Sequence[str], str]]) -> DataFrame:
    """Parent = parent or any child, rule after rule, so a later rule sees what an earlier one set."""
    for children, parent in rules:
        condition = F.coalesce(F.col(f"`{parent}`"), F.lit(False))
        for child in children:
            condition = condition | F.coalesce(F.col(f"`{child}`"), F.lit(False))
        flags = flags.withColumn(parent, condition)
    return flags


def replicate_labels(entities: DataFrame, labels: Sequence[str], replacement: str, group: Sequence[str] = ("note_id",)) -> DataFrame:
    """Copy entities with a listed label under a new label and id; one entity per (begin, end, label) stays.

    Originals win over copies, then the smallest id wins.
    """
    ranked = entities.withColumn("_rank", F.lit(0))
    copies = entities.filter(F.col("label").isin(list(labels))).select(
        *[
            F.lit(replacement).alias("label")
            if c == "label"
            else joined_id(F.lit("replicated"), "begin", "end", F.lit(replacement)).alias("id")
            if c == "id"
            else F.col(c)
            for c in entities.columns
        ],
        F.lit(1).alias("_rank"),
    )
    both = ranked.unionByName(copies)
    return dedupe_on(both, [*group, "begin", "end", "label"], ["_rank", "id"]).drop("_rank")


def snapshot_rows(snapshots: DataFrame, context_window: int = 100) -> tuple[DataFrame, DataFrame]:
    """Snapshot frames (notes array, annotator) -> seen documents and their entities, each with its context.

    Contexts are cut where the text is, before a note's entities become rows, so a text is never copied to its entities.
    """
    notes = snapshots.select("annotator", F.explode("notes").alias("_n")).filter(F.coalesce("_n.seen", F.lit(False)))
    documents = notes.select("_n.note_id", "_n.note_text", "annotator")
    fields = ["id", "text", "label", "begin", "end"]

    def with_context(e):
        return F.struct(*[e[f].alias(f) for f in fields], char_context(F.col("_n.note_text"), e["begin"], e["end"], context_window).alias("context"))

    entities = notes.select("_n.note_id", "annotator", F.transform("_n.entities", with_context).alias("_entities"))
    entities = entities.select("note_id", "annotator", F.inline("_entities"))
    return documents, entities


def process_annotations(
    documents: DataFrame,
    entities: DataFrame,
    task_names: Mapping[str, str],
    rules: Sequence[tuple[Sequence[str], str]] = (),
    priority: Sequence[str] | None = None,
    date_labels: Sequence[str] = ("date", "duration", "period"),
    positive: str = "1",
    negative: str = "0",
    context_window: int = 100,
    subset_notes: DataFrame | None = None,
) -> DataFrame:
    """Detected dates of the seen notes with one "0"/"1" column per task, taken from the overlapping highlights.

    `task_names` maps the label of a task to its column name (the whole task dimension, in order). Entities come with their `context`, as
    `snapshot_rows` makes them, or with the `note_text` to cut it from.
    """
    if "context" not in entities.columns:
        # Contexts are cut first, so that no later step carries a text per entity.
        entities = entities.withColumn("context", char_context("note_text", "begin", "end", context_window))
    entities = entities.drop("note_text")
    if subset_notes is not None:
        documents = documents.join(subset_notes.select("note_id").distinct(), "note_id", "left_semi")
        entities = entities.join(subset_notes.select("note_id").distinct(), "note_id", "left_semi")
    if priority:
        chosen = preferred_annotators(documents, priority)
        entities = entities.join(chosen, ["note_id", "annotator"], "left_semi")
    is_date = F.col("label").isin(list(date_labels))
    dates, highlights = entities.filter(is_date), entities.filter(~is_date)
    labels = list(task_names)
    flags = propagate_labels(pivot_labels(overlap_spans(highlights, dates), labels), rules)
    named = flags.select("note_id", "begin", "end", *[F.col(f"`{k}`").alias(v) for k, v in task_names.items()])
    joined = dates.join(named, ["note_id", "begin", "end"], "left")
    votes = [encode_labels(F.coalesce(F.col(v), F.lit(False)), positive, negative).alias(v) for v in task_names.values()]
    return joined.select(*dates.columns, *votes).withColumnRenamed("begin", "start")


def annotated_entities(
    documents: DataFrame, annotations: DataFrame, tasks: DataFrame, group_id: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Annotated spans with the id of their task, and the distinct seen notes; a label of two tasks stops the job."""
    seen = documents.filter(F.col("seen"))
    if group_id is not None:
        seen = seen.filter(F.col("screening_group") == group_id)
        annotations = annotations.filter(F.col("screening_group") == group_id)
    names = unique_by(tasks.select(F.col("Task Name (date de)").alias("label_label"), "task_id"), ["label_label"], "tasks")
    rows = annotations.join(names, "label_label", "inner").select(
        "note_id",
        F.col("begin_date").alias("start"),
        F.col("end_date").alias("end"),
        F.col("label_label").alias("ground_truth_task_label"),
        F.col("task_id").alias("ground_truth_task_id"),
    )
    return rows, seen.select("note_id").distinct()
