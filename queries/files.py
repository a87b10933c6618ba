"""Queries that write files made from the given tables to the shared folder and read them again."""

import json
import uuid

from pyspark.sql import functions as F

from clinspark.operators import lfs, spans as sp
from clinspark.operators.stored import prepare_folder
from clinspark.sources import annotation_files as af, dimensions as dim, sinks, tables as tb
from clinspark.sources.annotation_source import RECORD, AnnotationFolder, local_path
from queries import adapters as ad
from queries.adapters import with_ctes
from queries.registry import query
from queries.spans import SENTENCE_ROWS, PLACED, TERM


def scratch(spark, name):
    """A new path in the shared folder."""
    prepare_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def snapshot_notes(spark, d):
    """Every document as a note of a snapshot, with its numbers as entities."""
    return sp.preannotate(ad.notes(spark, d).withColumn("annotation_order", F.col("note_id")), {"number": "[0-9]+"})


NOTE_SQL = """SELECT CAST(n.note_id AS VARCHAR) AS note_id, CAST(n.person_id AS VARCHAR) AS person_id, CAST(n.note_date AS VARCHAR) AS note_date, md5(any_value(n.note_text)) AS text, false AS seen,
  CAST(count(s.start) AS INTEGER) AS n_entities, md5(coalesce(string_agg(s.start || '-' || s."end" || '-' || s.lexical_variant, '|' ORDER BY s.start), '')) AS entities
  FROM note n LEFT JOIN (SELECT * FROM span WHERE label = 'number') s ON s.note_id = n.note_id GROUP BY n.note_id, n.person_id, n.note_date"""


def _digest(notes, *extra):
    text = F.array_join(F.transform("entities", lambda e: F.concat_ws("-", e["begin"].cast("string"), e["end"].cast("string"), e["text"])), "|")
    return notes.select(
        *extra, "note_id", "person_id", "note_date", F.md5(F.coalesce("note_text", F.lit(""))).alias("text"), "seen",
        F.size("entities").alias("n_entities"), F.md5(F.coalesce(text, F.lit(""))).alias("entities"),
    )


@query("src_annotation_folder", with_ctes(NOTE_SQL, "span"))
def src_annotation_folder(spark, d):
    spark.dataSource.register(AnnotationFolder)
    path = local_path(scratch(spark, "annotations"))
    snapshot_notes(spark, d).write.format("annotation_folder").mode("append").save(path)
    return _digest(spark.read.format("annotation_folder").load(path))


@query("snk_annotation_record", "SELECT count(*) AS num_docs, count(DISTINCT doc_id % (SELECT count(DISTINCT user_id) FROM events)) AS num_patients FROM documents")
def snk_annotation_record(spark, d):
    spark.dataSource.register(AnnotationFolder)
    path = local_path(scratch(spark, "annotations"))
    snapshot_notes(spark, d).write.format("annotation_folder").mode("append").save(path)
    return spark.read.schema("num_docs long, num_patients long").json(f"file:{path}/{RECORD}")


@query("src_snapshots", with_ctes(f"SELECT a.annotator, x.* FROM ({NOTE_SQL}) x, (SELECT unnest(['first', 'second']) AS annotator) a", "span"))
def src_snapshots(spark, d):
    """Snapshot files of fifty notes each, read for two annotators."""
    notes = snapshot_notes(spark, d)
    block = F.floor(F.col("note_id").cast("bigint") / 50).alias("block")
    files = notes.groupBy(block).agg(F.collect_list(F.struct(*notes.columns)).alias("notes")).select("notes")
    path = sinks.write_dataset(files, scratch(spark, "snapshots"), "json")
    rows = af.read_snapshots(spark, {"first": path, "second": path}).select("annotator", F.inline("notes"))
    return _digest(rows, "annotator")


@query(
    "snk_datasets",
    with_ctes("SELECT f.format, span_id, start, lexical_variant FROM span, (SELECT unnest(['json', 'jsonl', 'parquet']) AS format) f", "span"),
)
def snk_datasets(spark, d):
    """The same rows written in each format and read again."""
    rows = ad.spans(spark, d).select("span_id", "start", "lexical_variant")
    out = None
    for name in ("parquet", "jsonl", "json"):
        path = sinks.write_dataset(rows, scratch(spark, name), name, batch_size=5000)
        read = spark.read.parquet(path) if name == "parquet" else spark.read.schema(rows.schema).json(path)
        read = read.select(F.lit(name).alias("format"), *rows.columns)
        out = read if out is None else out.unionByName(read)
    return out


@query(
    "snk_predictions",
    with_ctes("SELECT span_id, start, (SELECT count(*) FROM note) AS num_docs, 'a|b' AS tasks FROM span WHERE label = 'email'", "span"),
)
def snk_predictions(spark, d):
    rows = ad.spans(spark, d).filter("label = 'email'").select("span_id", "start")
    path = sinks.write_predictions(rows, ad.notes(spark, d), scratch(spark, "predictions"), ["a", "b"])
    record = spark.read.schema("num_docs long, inference_time_sec double, task_names array<string>").json(f"{path}.json")
    shown = record.filter("inference_time_sec >= 0").select("num_docs", F.array_join("task_names", "|").alias("tasks"))
    return spark.read.parquet(path).join(F.broadcast(shown))


@query("src_load_notes", "SELECT f.source, CAST(doc_id AS VARCHAR) AS note_id, md5(text) AS note_text FROM documents, (SELECT unnest(['csv', 'frame', 'parquet']) AS source) f")
def src_load_notes(spark, d):
    """Notes from a frame, Parquet files and a CSV file with line breaks and quotes in its texts."""
    notes = ad.table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("note_text"))
    parquet, csv = scratch(spark, "notes"), scratch(spark, "notes") + ".csv"
    sinks.write_new(notes, parquet, "parquet")
    notes.write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""').csv(csv, header=True)
    out = None
    for name, data in (("frame", notes), ("parquet", parquet), ("csv", csv)):
        text = F.coalesce("note_text", F.lit(""))
        rows = tb.load_notes(spark, data).select(F.lit(name).alias("source"), "note_id", F.md5(text).alias("note_text"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("src_localisations", "SELECT DISTINCT p_brand AS code, p_type AS system, p_type || p_size AS organ FROM part")
def src_localisations(spark, d):
    """The localisation sheet, written as CSV and read again."""
    sheet = ad.table(spark, d, "part").select(F.col("p_brand").alias("diag"), F.col("p_type").alias("Appareil"), F.concat("p_type", F.col("p_size").cast("string")).alias("Organe")).distinct()
    path = scratch(spark, "sheet")
    sinks.write_csv(sheet, path)
    return dim.read_localisations(dim.read_csv(spark, path))


PATTERN_FILE = {
    "Biopsy (procedure)": {"lf_name": "lf_terms", "terms": {"main": ["the", "und"], "more": ["e-mail"]}, "context_sents": 1, "attr": "TEXT"},
    "Imaging (procedure)": {"lf_name": "lf_unknown", "regex": {"main": ["[0-9]"]}, "context_sents": 1},
    "Endoscopy (procedure)": {"terms": {"main": ["x"]}},
}


@query(
    "src_pattern_file",
    with_ctes(
        f"""SELECT p.span_id, CASE WHEN regexp_matches(t.sentence, '{TERM % "the|und|e-mail"}') THEN 'Biopsy (procedure)' END AS lf_terms
        FROM placed p JOIN sentence_row t ON t.note_id = p.note_id AND t.sentence_id = p.sentence_id""",
        "span",
        sentence_row=SENTENCE_ROWS,
        placed=PLACED,
    ),
)
def src_pattern_file(spark, d):
    """Votes of a pattern file: an entry without a name and one that is not in the reference are skipped."""
    path = f"{local_path(scratch(spark, 'patterns'))}.json"
    with open(path, "w", encoding="utf-8") as file:
        json.dump(PATTERN_FILE, file)
    functions, skipped = lfs.load_patterns(path, known_lfs=["lf_terms"])
    if len(skipped) != 2:
        raise ValueError(f"unexpected entries: {skipped}")
    return lfs.pattern_voted_spans(ad.notes(spark, d), functions, ad.SPAN_PATTERNS, ad.SPAN_KEYS).select("span_id", "lf_terms")


@query("lf_spans_to_rows", with_ctes('SELECT note_id, person_id, lang, lexical_variant, label, start, "end" FROM span JOIN (SELECT note_id, lang FROM note) USING (note_id)', "span"))
def lf_spans_to_rows(spark, d):
    """Notes with an array of spans, and back to rows with note attributes."""
    return sp.spans_to_rows(sp.span_lists(ad.notes(spark, d), ad.SPAN_PATTERNS), doc_attributes=("person_id", "lang"))
