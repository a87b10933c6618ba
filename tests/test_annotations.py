import random

import pytest
from pyspark.sql import functions as F

from clinspark.operators import annotations as an
from clinspark.reference_values import HIERARCHY_RULES

SPAN = "note_id long, begin int, end int, label string"
HIGHLIGHTS = {1: (17, 39), 2: (17, 36), 3: (35, 45), 4: (34, 45), 5: (30, 45)}


def overlaps(spark, highlights, dates):
    rows = an.overlap_spans(spark.createDataFrame(highlights, SPAN), spark.createDataFrame(dates, SPAN)).collect()
    return sorted((r.note_id, r.begin, r.end, r.label) for r in rows)


def test_overlap_golden(spark):
    dates = [(n, b, e, "date") for n in HIGHLIGHTS for b, e in ((0, 5), (34, 37), (49, 52))]
    highlights = [(n, b, e, "Biopsie") for n, (b, e) in HIGHLIGHTS.items()] + [(n, 7, 10, "mistake") for n in HIGHLIGHTS]
    assert overlaps(spark, highlights, dates) == [(n, 34, 37, "Biopsie") for n in HIGHLIGHTS]


def test_overlap_edges(spark):
    assert overlaps(spark, [(1, 5, 9, "A"), (1, 4, 5, "A")], [(1, 0, 5, "date")]) == [(1, 0, 5, "A")]
    assert overlaps(spark, [(1, 6, 9, "A")], [(1, 0, 5, "date")]) == []
    assert overlaps(spark, [(2, 0, 9, "A")], [(1, 0, 5, "date")]) == []


def test_overlap_equals_brute_force(spark):
    rng = random.Random(1)
    dates = list({(n, b, b + rng.randrange(0, 90), "date") for n in range(3) for b in rng.sample(range(700), 40)})
    highlights = [(rng.randrange(3), b := rng.randrange(700), b + rng.randrange(0, 200), rng.choice("ABC")) for _ in range(60)]
    want = sorted({(n, b, e, hl) for n, b, e, _ in dates for hn, hb, he, hl in highlights if n == hn and hb <= e and b <= he})
    assert overlaps(spark, highlights, dates) == want


def test_hierarchy_runs_in_order(spark):
    labels = sorted({x for children, parent in HIERARCHY_RULES for x in [*children, parent]})
    rows = [("TEP scan",), ("Coloscopie",), ("Biopsie",), ("Fibroscopie bronchique",)]
    flags = spark.createDataFrame(rows, "hit string").select("hit", *[(F.col("hit") == x).alias(x) for x in labels])
    out = {r.hit: {x for x in labels if r[x]} for r in an.propagate_labels(flags, HIERARCHY_RULES).collect()}
    assert out["TEP scan"] == {"TEP scan", "Imagerie de médecine nucléaire", "Imagerie médicale"}
    assert out["Coloscopie"] == {"Coloscopie", "Endoscopie digestive", "Endoscopie"}
    assert out["Biopsie"] == {"Biopsie", "Examen anatomopathologique"}
    assert out["Fibroscopie bronchique"] == {"Fibroscopie bronchique", "Endoscopie"}


def test_annotator_priority(spark):
    df = spark.createDataFrame([(1, "x"), (1, "b"), (2, "x"), (2, "y"), (3, "a")], "note_id int, annotator string")
    rows = an.prefer_annotator(df, ["a", "b"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "b"), (2, "x"), (3, "a")]


def test_replication(spark):
    df = spark.createDataFrame([(1, "i1", "t", "A", 0, 3), (1, "i2", "t", "N", 0, 3), (2, "i3", "t", "B", 1, 2)], "note_id int, id string, text string, label string, begin int, end int")
    rows = an.replicate_labels(df, ["A", "B"], "N").collect()
    assert sorted((r.note_id, r.label, r.id) for r in rows) == [(1, "A", "i1"), (1, "N", "i2"), (2, "B", "i3"), (2, "N", "replicated-1-2-N")]


def test_process_annotations(spark):
    text = "IRM le 12/03 puis TEP le 14/03"
    snapshot = [
        ("n1", text, True, [("d1", "12/03", "date", 7, 12), ("d2", "14/03", "date", 25, 30), ("h1", "IRM le 12", "IRM", 0, 9), ("h2", "TEP le", "TEP scan", 18, 26)]),
        ("n2", text, False, [("d1", "12/03", "date", 7, 12)]),
    ]
    other = [("n1", text, True, [("d1", "12/03", "date", 7, 12), ("h1", "x", "TEP scan", 5, 9)])]
    kind = "notes array<struct<note_id:string,note_text:string,seen:boolean,entities:array<struct<id:string,text:string,label:string,begin:int,end:int>>>>, annotator string"
    frames = spark.createDataFrame([(snapshot, "main"), (other, "second")], kind)
    documents, entities = an.snapshot_rows(frames, context_window=4)
    assert "note_text" not in entities.columns
    names = {"IRM": "mri", "TEP scan": "pet", "Imagerie médicale": "imaging"}
    rules = [(["TEP scan", "IRM"], "Imagerie médicale")]
    rows = an.process_annotations(documents, entities, names, rules, priority=["main"], context_window=4).orderBy("start").collect()
    assert [(r.note_id, r.start, r.end, r.mri, r.pet, r.imaging, r.context) for r in rows] == [
        ("n1", 7, 12, "1", "0", "1", " le 12/03 pui"),
        ("n1", 25, 30, "0", "1", "1", " le 14/03"),
    ]
    subset = spark.createDataFrame([("zz",)], "note_id string")
    assert an.process_annotations(documents, entities, names, rules, subset_notes=subset).count() == 0


def test_annotated_entities_without_group(spark):
    docs = spark.createDataFrame([(1, True, 1), (2, False, 1)], "note_id int, seen boolean, screening_group int")
    spans = spark.createDataFrame([(1, 0, 3, "IRM", 1), (1, 5, 8, "other", 1)], "note_id int, begin_date int, end_date int, label_label string, screening_group int")
    tasks = spark.createDataFrame([("IRM", 5)], "`Task Name (date de)` string, task_id int")
    rows, notes = an.annotated_entities(docs, spans, tasks)
    assert [r.ground_truth_task_id for r in rows.collect()] == [5]
    assert [r.note_id for r in notes.collect()] == [1]
    with_group, _ = an.annotated_entities(docs, spans, tasks, group_id=2)
    assert with_group.count() == 0
