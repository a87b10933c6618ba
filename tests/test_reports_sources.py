import datetime
import json

import pytest
from pyspark.sql import functions as F, types as T

from clinspark.functions.keys import prefixed_reference
from clinspark.operators import evaluation as evl, fhir
from clinspark.plans import knowledge as kn, prediction as pr
from clinspark.sources import annotation_files as af, dimensions as dim, sinks, tables as tb

KEYS = "note_id string, start int, end int, label string"


def frame(spark, rows, *tasks):
    return spark.createDataFrame([(str(i), 0, 5, "date", *r) for i, r in rows], f"{KEYS}, " + ", ".join(f"{t} string" for t in tasks))


def test_metrics_golden(spark):
    gold = frame(spark, [(1, ("1", "0")), (2, ("1", "0")), (3, ("0", "0")), (4, ("0", "0"))], "a", "b")
    pred = frame(spark, [(1, ("1", "0")), (3, ("1", "1")), (4, ("0", "0")), (9, ("1", "1"))], "a", "b")
    rows = {(r.task, r["class"]): r for r in evl.evaluate(gold, pred, ["a", "b"]).collect()}
    one = rows[("a", "1")]
    assert (one.precision, one.recall, one.support, one.n_instances) == (1 / 3, 0.5, 2, 4)
    assert abs(one.fscore - 0.4) < 1e-12
    zero = rows[("a", "0")]
    assert (zero.precision, zero.recall, zero.support) == (0.5, 1 / 3, 3)
    assert rows[("b", "1")][2:6] == (0.0, 0.0, 0.0, 0) and rows[("b", "0")][2:6] == (0.0, 0.0, 0.0, 0)


def test_prediction_columns():
    columns = ["a_llm", "b", "cllm", "c"]
    assert evl.resolve_prediction_columns(columns, ["a", "b", "c", "d"], "llm") == ({"a": "a_llm", "b": "b", "c": "cllm"}, ["d"])
    assert evl.resolve_prediction_columns(columns, ["a", "b"], None) == ({"b": "b"}, ["a"])


def test_evaluate_many_reports_skipped_tasks(spark):
    gold = frame(spark, [(1, ("1", "0"))], "a", "b")
    pred = frame(spark, [(1, ("true",)), (5, ("true",))], "a")
    rows, skipped = evl.evaluate_many({"A": gold}, {("m", "A"): (pred, None)}, ["a", "b"])
    assert skipped == [("m", "A", "b")]
    assert rows.filter("class = '1'").first().fscore == 1.0
    with pytest.raises(ValueError):
        evl.prediction_frame(pred.drop("start"), ["a"])


def test_agreement(spark):
    first = frame(spark, [(1, ("1",)), (2, ("1",)), (3, ("0",)), (4, ("0",)), (7, ("1",))], "a")
    second = frame(spark, [(1, ("1",)), (2, ("0",)), (3, ("0",)), (4, ("0",)), (8, ("1",))], "a")
    pairs = evl.paired_annotations(first, second, ["a"], ["note_id", "start", "end", "label"])
    row = evl.agreement(pairs, ["a"]).first()
    assert (round(row.kappa, 6), round(row.f1, 6), row.n_discordances, row.n_positive_a, row.n_positive_b) == (0.5, 0.666667, 1, 2, 1)
    assert [(r.note_id, r.label_a, r.label_b) for r in evl.discordances(pairs, ["a"], ["note_id"]).collect()] == [("2", "1", "0")]


def registry(spark, second_name="All tasks"):
    models = spark.createDataFrame([("m1", "c", "All tasks", None, 1), ("m2", "c", second_name, None, 1)], "id string, name_code string, name_display string, task_name string, active int")
    metrics = spark.createDataFrame(
        [("m1", "c", "A", "t1", "1", 0.4, 9, 1), ("m1", "c", "A", "t1", "1", 0.5, 9, 2), ("m2", "c", "A", "t1", "1", 0.7, 9, 1), ("m2", "c", "A", "zz", "1", 0.9, 1, 1)],
        "model_id string, name_code string, dataset string, task string, class string, fscore double, support int, produced_at int",
    )
    tasks = spark.createDataFrame([(1, "T1", "t1"), (2, "T2", "t2")], "task_id int, snomed_short_name string, normalized_task_name string")
    return models, metrics, tasks


def test_metrics_table_takes_the_latest_and_checks(spark):
    models, metrics, tasks = registry(spark, "Zeta")
    table = evl.metrics_table(models, metrics, tasks, ["Zeta", "All tasks"], datasets=("A",))
    assert table.columns == ["task", "Task id", "Task (Procedure)", "Support|A", "All tasks|A", "Zeta|A"]
    assert [tuple(r) for r in table.collect()] == [("t1", 1, "T1", 9, 0.5, 0.7), ("t2", 2, "T2", None, None, None)]
    with pytest.raises(Exception, match="duplicate name_display: All tasks"):
        evl.metrics_table(*registry(spark), ["All tasks"]).collect()
    assert evl.metrics_table(*registry(spark), ["All tasks"], check=False).count() == 2
    bad = metrics.withColumn("support", F.when(F.col("model_id") == "m2", 8).otherwise(F.col("support")))
    with pytest.raises(Exception, match="support mismatch for task t1 dataset A"):
        evl.metrics_table(models, bad, tasks, ["Zeta"]).collect()


def test_metrics_table_is_one_job(spark):
    """The checks are part of the table: nothing runs before the table is asked for, and then one query does."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("metrics-table", "")
    try:
        table = evl.metrics_table(*registry(spark, "Zeta"), ["Zeta", "All tasks"])
        assert len(tracker.getJobIdsForGroup("metrics-table")) == 0
        assert table.count() == 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_names_in_texts(spark):
    from clinspark.operators.vocabulary import find_names, regex_chunks

    texts = spark.createDataFrame([(1, "Été: Taxol-5, PACLITAXEL albumine; taxol 5"), (2, None), (3, ""), (4, "albumine")], "note_id long, note_text string")
    listed = [("taxol 5", "a"), ("Taxol", "a"), ("paclitaxel  (albumine)", "b"), ("albumine", None), ("albumine", "c"), (None, "d"), ("+", "e"), ("albumine x y z", "f"), ("été", "g"), ("été", "g")]
    names = spark.createDataFrame(listed, "name string, kind string")
    got = sorted(map(tuple, find_names(texts, names, keep=("kind",)).collect()), key=str)
    want = [(1, 0, "été", "g"), (1, 1, "taxol 5", "a"), (1, 1, "Taxol", "a"), (1, 3, "paclitaxel  (albumine)", "b"), (1, 4, "albumine", None), (1, 4, "albumine", "c"),
            (1, 5, "taxol 5", "a"), (1, 5, "Taxol", "a"), (4, 0, "albumine", None), (4, 0, "albumine", "c")]
    assert got == sorted(want, key=str)
    assert find_names(texts, names.limit(0)).count() == 0 and find_names(texts.limit(0), names).count() == 0
    many = spark.range(1000).select(F.lit("k").alias("kind"), F.concat(F.lit("n."), "id").alias("name"))
    chunks = regex_chunks(many, ["kind"], chunk=100).collect()
    assert len(chunks) == 10 and max(len(c["names"]) for c in chunks) < 200
    assert sorted(n for c in chunks for n in c["names"]) == sorted(f"n.{i}" for i in range(1000))
    holding = spark.createDataFrame([c for c in chunks if "n.17" in c["names"]])
    assert holding.filter(F.expr("'xN.17 ' rlike regex")).count() == 1 and holding.filter(F.expr("'xNx17 ' rlike regex")).count() == 0


def test_procedure_flattening(spark):
    rows = spark.createDataFrame(
        [("456", 123, datetime.date(2026, 3, 1), 350, 365, "date", "27 février 2026", "mri_procedure", 0.95, "ctx")],
        "note_id string, person_id long, note_date date, start int, end int, label string, lexical_variant string, task_name string, score double, context string",
    )
    tasks = spark.createDataFrame([("mri_procedure", "Magnetic resonance imaging (procedure)", 113091000)], "normalized_task_name string, task string, `SNOMED CT - SCTID` long")
    flat = fhir.flatten_struct(fhir.to_procedure(rows, tasks), "procedure", resource_type="Procedure")
    row = flat.first().asDict()
    assert row["resourceType"] == "Procedure" and row["status"] == "completed" and row["id"] is None
    assert row["code__coding___0__code"] == "113091000" and row["code__coding___0__system"] == "https://www.snomed.org/"
    assert row["subject__reference"] == "Patient/123" and row["meta__security___0__code"] == "AIAST"
    assert row["performedDateTime"] == datetime.date(2026, 2, 27)
    assert row["extension_nlp___0__id"] == "456-350-365-date-mri_procedure"
    assert row["extension_nlp___0__document_reference__reference"] == "DocumentReference/456"
    assert row["extension_nlp___0__span_start"] == 350 and row["extension_nlp___0__related_span"] is None
    out = fhir.predictions_to_fhir(rows, tasks, "best").first().asDict()
    assert out["meta__source"] == "nlp_model_best" and out["id"] and "encounter" not in out


def test_flatten_rules(spark):
    kind = T.StructType([T.StructField("a", T.StructType([T.StructField("b", T.IntegerType())])), T.StructField("c", T.ArrayType(T.IntegerType()))])
    df = spark.createDataFrame([(((1,), [5, 6]),), ((None, []),), (((2,), None),)], T.StructType([T.StructField("v", kind)]))
    rows = fhir.flatten_struct(df, "v", {"c": 2}, resource_type="X").collect()
    assert [tuple(r) for r in rows] == [("X", 1, 5, 6), ("X", None, None, None), ("X", 2, None, None)]
    assert fhir.flatten_struct(df, "v", {"c": 0}).columns == ["a__b", "c"]


def test_references(spark):
    df = spark.createDataFrame([("", 5), ("kept", 5), (None, None)], "r string, i long")
    assert [x[0] for x in df.select(prefixed_reference("Patient", "r", "i")).collect()] == ["Patient/5", "kept", None]


def test_infer_to_fhir_and_long(spark):
    import pandas as pd

    notes = spark.createDataFrame([("n1", 7, datetime.date(2021, 1, 1), "IRM le 12/03/2020, TEP le 01/02/2020")], "note_id string, person_id long, note_date date, note_text string")
    tasks = spark.createDataFrame([("mri", "MRI (procedure)", 1)], "normalized_task_name string, task string, `SNOMED CT - SCTID` long")

    def scorer(batch):
        return pd.DataFrame({"mri_1": [0.9 if s < 10 else 0.1 for s in batch["start"]]})

    rows = pr.infer(notes, scorer, ["mri"], tasks, "m").collect()
    assert len(rows) == 1 and rows[0].performedDateTime == datetime.date(2020, 3, 12)
    long = pr.infer(notes, scorer, ["mri"], export_to_fhir=False, long_format=True).collect()
    assert [(r.task_name, r.score) for r in long] == [("mri", 0.9)]
    assert pr.infer(notes, scorer, ["mri"], export_to_fhir=False).count() == 2


# ---------------------------------------------------------------- sources and sinks


def test_read_table_and_filters(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "_subjectReferenceId long, code__text string")
    df.write.parquet(str(tmp_path / "condition"))
    got = tb.read_table(spark, "condition", folder=str(tmp_path), columns=["person_id", "condition_source_value"])
    assert got.count() == 3
    assert tb.rows_per_file(got.sparkSession.read.parquet(str(tmp_path / "condition"))).selectExpr("sum(n_rows)").first()[0] == 3
    for values in ([1], [1] + list(range(10, 2010))):
        assert [r.person_id for r in tb.keep_avoid(got, keep=values).collect()] == [1]
        assert [r.person_id for r in tb.keep_avoid(got, avoid=values).collect()] == [2]
    got.write.saveAsTable("condition_names")
    assert tb.read_table(spark, "condition_names", db="default").count() == 3


def test_cast_to_tz(spark):
    df = spark.sql("select timestamp'2024-01-01 12:00:00' t, timestamp_ntz'2024-07-01 12:00:00' n")
    row = tb.cast_to_tz(df, "Europe/Paris").select(F.col("t").cast("string"), F.col("n").cast("string")).first()
    assert tuple(row) == ("2024-01-01 13:00:00", "2024-07-01 14:00:00")


def test_load_notes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc')], "note_id long, note_text string")
    df.write.parquet(str(tmp_path / "notes"))
    (tmp_path / "n.csv").write_text('note_id,note_text\n1,"a ""b""\nc"\n')
    for data in (df, str(tmp_path / "notes"), str(tmp_path / "n.csv")):
        assert [tuple(r) for r in tb.load_notes(spark, data).collect()] == [("1", 'a "b"\nc')]
    with pytest.raises(ValueError):
        tb.load_notes(spark, "notes.xlsx")


def test_annotation_folder(spark, tmp_path):
    for patient in ("p1", "p2"):
        folder = tmp_path / "a" / patient
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text(json.dumps({"person_id": patient}, indent=1))
        (folder / "note.txt").write_text("line one\nline two")
        (folder / "note.json").write_text(json.dumps({"note_id": f"n-{patient}", "seen": True, "entities": [{"id": "e", "label": "date", "begin": 0, "end": 4}]}, indent=1))
    docs, patients = af.read_annotation_folder(spark, str(tmp_path / "a"))
    rows = docs.orderBy("note_id").collect()
    assert [(r.note_id, r.note_text, r.entities[0].end) for r in rows] == [("n-p1", "line one\nline two", 4), ("n-p2", "line one\nline two", 4)]
    assert patients.count() == 2
    (tmp_path / "a" / "p1" / "note.json").write_text("{broken")
    with pytest.raises(Exception):
        af.read_annotation_folder(spark, str(tmp_path / "a"))[0].collect()


def test_snapshots(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"notes": [{"note_id": "1", "seen": True, "entities": []}]}))
    rows = af.read_snapshots(spark, {"x": str(tmp_path / "s.json"), "y": str(tmp_path / "s.json")})
    assert sorted(r.annotator for r in rows.collect()) == ["x", "y"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, None) for i in range(6)], "id int, v string").coalesce(1)
    assert spark.read.parquet(sinks.write_dataset(df, str(tmp_path / "p"), batch_size=2)).count() == 6
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 3
    assert len(list(tmp_path.joinpath(sinks.write_dataset(df, str(tmp_path / "j"), "json")).glob("*.json"))) == 6
    text = "".join(f.read_text() for f in tmp_path.joinpath(sinks.write_dataset(df, str(tmp_path / "l"), "jsonl")).glob("*.json"))
    assert text.count('"v":null') == 6
    with pytest.raises(ValueError):
        sinks.write_dataset(df, str(tmp_path / "x"), "pickle")
    with pytest.raises(Exception):
        sinks.write_dataset(df, str(tmp_path / "p"), overwrite=False)
    sinks.write_new(df, str(tmp_path / "new"))
    with pytest.raises(Exception):
        sinks.write_new(df, str(tmp_path / "new"))
    path = sinks.write_predictions(df, df, str(tmp_path / "pred"), ["a", "b"])
    record = spark.read.json(f"{path}.json").first()
    assert (record.num_docs, record.task_names) == (6, ["a", "b"])
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_table(df, "written_rows")
    assert spark.table("written_rows").count() == 6


def test_dimensions(spark):
    raw = spark.createDataFrame([(1, "lf_1", "regex", "ok"), (9, "lf_9", "code", None)], "`Task Number` int, ref_name string, `LF type` string, Implemented string")
    tasks = dim.read_tasks(spark.createDataFrame([(1, "Biopsy (procedure)")], "`Task Number` int, `SNOMED CT - Fully Specified Name (FSN)` string"))
    rows, names = dim.read_lf_reference(raw, tasks)
    assert rows.first().normalized_task_name == "biopsy_procedure" and names.count() == 1
    assert dim.read_lf_reference(raw, tasks, None)[0].count() == 2
    places = dim.read_localisations(spark.createDataFrame([("C50", "Sein", "Sein g")], "diag string, Appareil string, Organe string"))
    assert places.columns == ["code", "system", "organ"]


def test_event_dates(spark):
    df = spark.createDataFrame([("2020-01-02",), ("bad",), (None,)], "event_date string")
    assert [r.event_date for r in kn.clean_dates(df).collect()] == [datetime.date(2020, 1, 2)]
    events = spark.createDataFrame([(1, "lf_ccam", datetime.date(2020, 1, 1), "A"), (1, "lf_ccam", datetime.date(2020, 1, 1), "A")], "person_id long, lf string, event_date date, class string")
    wide = kn.external_knowledge(events).first()
    assert len(wide.lf_ccam) == 1 and wide.lf_drugs is None and wide.lf_icd10 is None
    named = events.withColumn("task_id", F.lit(4))
    assert kn.with_task_names(named).count() == 2
    with pytest.raises(Exception, match="event without a task name: task 4"):
        kn.with_task_names(named.withColumn("class", F.lit(None).cast("string"))).collect()


def test_a_task_listed_twice_stops_the_job(spark):
    tasks = spark.createDataFrame([(1, "a", "A"), (1, "b", "B")], "task_id int, normalized_task_name string, `Task Name (date de)` string")
    raw = spark.createDataFrame([(1, "lf_1", "regex", "ok")], "`Task Number` int, ref_name string, `LF type` string, Implemented string")
    with pytest.raises(Exception, match="tasks: key"):
        dim.read_lf_reference(raw, tasks)[0].collect()
    assert dim.read_lf_reference(raw, tasks.filter("normalized_task_name = 'a'"))[0].count() == 1


def test_many_prediction_sets_equal_single_ones(spark):
    """Sets with other tasks, other notes, repeated keys and nulls, against one evaluation each."""
    import random

    rng = random.Random(12)
    kind = "note_id long, start int, `end` int, label string, a string, b string"
    gold = {d: spark.createDataFrame([(n, s, s + 1, "date", rng.choice("01"), rng.choice(["0", "1", None])) for n in range(12) for s in range(4)], kind) for d in "XY"}
    frames = [spark.createDataFrame([(n, s, s + 1, "date", rng.choice("01"), rng.choice("01")) for n in range(2, 15) for s in range(1, 6)], kind) for _ in range(3)]
    sets = {("m0", "X"): (frames[0], None), ("m1", "X"): (frames[1].withColumnRenamed("b", "b_llm"), "llm"), ("m2", "Y"): (frames[2].drop("a"), None), ("m3", "Y"): (frames[2].drop("a", "b"), None)}
    rows, skipped = evl.evaluate_many(gold, sets, ["a", "b"])
    assert skipped == [("m2", "Y", "a"), ("m3", "Y", "a"), ("m3", "Y", "b")]
    got = sorted(map(tuple, rows.collect()))
    want = []
    for (model, dataset), (frame, suffix) in sets.items():
        prepared, missing = evl.prediction_frame(frame, ["a", "b"], suffix)
        known = [t for t in "ab" if t not in missing]
        if known:
            prepared = prepared.join(gold[dataset].select("note_id").distinct(), "note_id", "left_semi")
            want += [(model, dataset, *r) for r in evl.evaluate(gold[dataset], prepared, known).collect()]
    assert got == sorted(want) and len(got) == 10


def test_annotation_folder_source(spark, tmp_path):
    """Written notes come back as they were, however they were split; parts of pairs are left out; broken files raise."""
    from clinspark.sources import annotation_source as src

    spark.dataSource.register(src.AnnotationFolder)
    kind = "note_id string, person_id string, note_date string, note_text string, annotation_order long, seen boolean, entities array<struct<id:string,text:string,label:string,begin:int,end:int>>"
    rows = [(f"n{k}", f"p{k % 7}", "2024-01-02", 'line\r\nZwölf "12"\n', k, k % 2 == 0, [("e", "12", "number", 7, 9), (None, None, None, None, None)]) for k in range(40)]
    rows += [("n40", "p9", None, None, None, None, None)]
    path = str(tmp_path / "notes")
    spark.createDataFrame(rows, kind).repartition(5).write.format("annotation_folder").mode("append").save(path)
    read = spark.read.format("annotation_folder").load(f"file:{path}")
    got = {r["note_id"]: r for r in read.collect()}
    assert len(got) == 41 and tuple(got["n3"])[:6] == rows[3][:6] and [tuple(e) for e in got["n3"]["entities"]] == rows[3][6]
    assert (got["n40"]["person_id"], got["n40"]["note_text"], got["n40"]["entities"]) == ("p9", "", [])
    assert json.loads((tmp_path / "notes" / "record.json").read_text()) == {"num_docs": 41, "num_patients": 8}
    # The plain readers see the same notes, but for the one without text.
    notes, patients = af.read_annotation_folder(spark, path)
    assert {r["note_id"] for r in notes.collect()} == set(got) - {"n40"} and patients.count() == 8
    (tmp_path / "notes" / "p0" / "n0.txt").rename(tmp_path / "notes" / "p0" / "other.txt")
    assert read.count() == 40
    (tmp_path / "notes" / "p1" / "n1.json").write_text("{broken")
    with pytest.raises(Exception, match="cannot be read"):
        read.collect()
    with pytest.raises(Exception, match="need the columns"):
        spark.range(1).write.format("annotation_folder").mode("append").save(path)
    assert src.local_path("file:///a/b") == "/a/b"
    with pytest.raises(ValueError):
        src.local_path("store://a")


def test_annotation_folder_partitions(tmp_path):
    from clinspark.sources import annotation_source as src

    for k in range(src.FOLDERS + 1):
        (tmp_path / f"p{k}").mkdir()
    found = src.FolderReader(str(tmp_path)).partitions()
    assert [len(f.paths) for f in found] == [src.FOLDERS, 1] and src.FolderReader(str(tmp_path / "p0")).partitions() == []


def test_token_runs_of_texts_are_not_moved(spark, monkeypatch):
    """A vocabulary of bounded size goes to the texts; a larger one gives the same rows by a join on keys."""
    from clinspark.operators import vocabulary as voc

    texts = spark.createDataFrame([(k, f"Vitamine b{k % 7} et é-{k % 5}, b{k % 3}") for k in range(60)], "note_id long, note_text string")
    names = spark.createDataFrame([(f"b{k}",) for k in range(7)] + [("E 3",), ("vitamine B1",), (None,), ("-",)], "name string")
    rows = voc.find_names(texts, names)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan.split("BroadcastHashJoin")[1].split("BroadcastExchange")[0]
    want = sorted(map(tuple, rows.collect()))
    monkeypatch.setattr(voc, "BROADCAST_NAMES", 3)
    assert sorted(map(tuple, voc.find_names(texts, names).collect())) == want and len(want) > 120


def test_a_task_writes_the_metadata_of_a_patient_once(tmp_path, monkeypatch):
    from pyspark.sql import Row

    from clinspark.schemas import SNAPSHOT_NOTE
    from clinspark.sources import annotation_source as src

    placed, place = [], src._place
    monkeypatch.setattr(src, "_place", lambda path, text: (placed.append(path), place(path, text)))
    blank = dict.fromkeys(SNAPSHOT_NOTE.names)
    notes = [Row(**{**blank, "note_id": str(k), "person_id": str(k % 2), "note_text": f"t{k}", "entities": []}) for k in range(6)]
    written = src.FolderWriter(str(tmp_path), SNAPSHOT_NOTE).write(iter(notes))
    assert (written.notes, written.patients) == (6, ["0", "1"]) and len(placed) == 2 + 2 * 6
    reader = src.FolderReader(str(tmp_path))
    assert sorted(r[SNAPSHOT_NOTE.names.index("note_text")] for part in reader.partitions() for r in reader.read(part)) == [f"t{k}" for k in range(6)]
