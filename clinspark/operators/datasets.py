"""Training sets: notes with their labelled spans, merges over tasks, and summary cards."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from clinspark.functions.text import encode_labels

SPAN_KEYS = ("person_id", "note_id", "lexical_variant", "label", "start", "end", "context")


def build_dataset(
    notes: DataFrame,
    spans: DataFrame,
    attributes: Sequence[str] = (),
    doc_attributes: Sequence[str] = ("note_datetime", "person_id"),
    span_label: str = "date",
    note: str = "note_id",
    draw: str | None = None,
    block_chars: int | None = None,
    block_copies: int | None = None,
) -> DataFrame:
    """One row per note with spans: its text, the asked columns and the spans as an array sorted by start, end and all that follows.

    The caller may ask for smaller arrays: with `block_chars` a note gives one row per so many characters, with `block_copies`
    one per so many copies of its drawn spans (`draw` numbers the copies of a span); `part` names the block. By default there
    is one row per note, whatever its size.
    """
    # Maps have no order: they are sorted as their entries and made again afterwards.
    maps = [a for a in attributes if isinstance(spans.schema[a].dataType, T.MapType)]
    fixed = ["start_char", "end_char", "lexical_variant", "note_nlp_source_value"]
    entity = F.struct(
        F.col("start").alias("start_char"),
        F.col("end").alias("end_char"),
        "lexical_variant",
        F.lit(span_label).alias("note_nlp_source_value"),
        *[F.map_entries(a).alias(a) if a in maps else F.col(a) for a in attributes],
    )

    def with_maps(e):
        return F.struct(*[e[f].alias(f) for f in fixed], *[(F.map_from_entries(e[a]) if a in maps else e[a]).alias(a) for a in attributes])

    def in_order(entities):
        ordered = F.sort_array(F.collect_list(entities))
        return F.transform(ordered, with_maps) if maps else ordered

    block = F.lit(0) if block_chars is None else F.floor(F.col("start") / block_chars)
    copies = F.lit(0) if draw is None or block_copies is None else F.floor(F.col(draw) / block_copies)
    part = F.concat_ws(".", block.cast("string"), copies.cast("string"))
    grouped = spans.groupBy(note, part.alias("part")).agg(in_order(entity).alias("entities"))
    docs = notes.select(note, "note_text", *[c for c in doc_attributes if c in notes.columns and c != note])
    return docs.join(grouped, note, "inner")


def read_dataset(dataset: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """Training set -> one row per span with its attributes."""
    rows = dataset.select("note_id", F.explode("entities").alias("_e"))
    return rows.select(
        "note_id",
        F.col("_e.start_char").alias("start"),
        F.col("_e.end_char").alias("end"),
        "_e.lexical_variant",
        F.col("_e.note_nlp_source_value").alias("label"),
        *[f"_e.{a}" for a in attributes],
    )


def merge_tasks(labels: Mapping[str, DataFrame], keys: Sequence[str] = SPAN_KEYS, suffix: str | None = None) -> DataFrame:
    """Label sets of several tasks side by side; the first task's spans are the universe.

    All sets are stacked and grouped once on the span key, instead of one join per task.
    """
    tasks = list(labels)
    stacked = None
    for i, (task, df) in enumerate(labels.items()):
        source = f"{task}{suffix}" if suffix and f"{task}{suffix}" in df.columns else task
        value = encode_labels(source, "1", "0") if dict(df.dtypes)[source] == "boolean" else F.col(source).cast("string")
        columns = [value.alias(t) if t == task else F.lit(None).cast("string").alias(t) for t in tasks]
        rows = df.select(*keys, *columns, F.lit(i == 0).alias("_first"))
        rows = rows.withColumn("_set", F.lit(i))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    # Rows are first grouped by set and key: a key that a set holds twice stops the job.
    repeated = F.raise_error(F.lit(f"merge_tasks: key {list(keys)} is not unique")).cast("boolean")
    stacked = (
        stacked.groupBy("_set", *keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in [*tasks, "_first"]])
        .filter(F.when(F.col("_rows") == 1, F.lit(True)).otherwise(repeated))
    )
    merged = stacked.groupBy(*keys).agg(*[F.max(t).alias(t) for t in tasks], F.max("_first").alias("_first"))
    return merged.filter("_first").drop("_first")


def dataset_card(spans: DataFrame, positive=None, note: str = "note_id", entity: str = "instance_id") -> DataFrame:
    """Documents, entities, positives and negatives in one row."""
    measures = [
        F.count_distinct(note).alias("n_documents"),
        F.count_distinct(entity).alias("n_entities"),
    ]
    if positive is not None:
        flag = F.col(positive) if isinstance(positive, str) else positive
        measures += [F.count_if(flag).alias("n_positive_examples"), F.count_if(~flag).alias("n_negative_examples")]
    return spans.agg(*measures)


def fingerprint(df: DataFrame) -> DataFrame:
    """Content fingerprint that does not depend on row order or file layout."""
    columns = sorted(df.columns)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    return df.select(row_hash.alias("_h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor("_h").alias("hash_xor"),
    )


def text_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Portable variant over the text of the columns: sum of 60-bit md5 prefixes."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    word = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return df.select(word.alias("_h")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("hash_sum")
    )
