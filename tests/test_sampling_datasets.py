import math
import random

import pytest
from pyspark.sql import functions as F

from clinspark.operators import datasets as ds, groups as gr, sampling as sm
from clinspark.plans import selection as se


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", 1 if i % 3 == 0 else rng.randrange(2, 9), rng.randrange(60000), round(rng.random(), 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "span_id string, note_id long, start int, biopsy_procedure_1 double")
    return df.withColumn("end", F.col("start") + 8).withColumn("lexical_variant", F.lit("x")).withColumn("biopsy_procedure", F.lit("m"))


def ids(df, column="span_id"):
    return sorted(r[column] for r in df.select(column).collect())


@pytest.mark.parametrize("n", [0, 1, 50, 600, 9999])
def test_sample_size_and_layout(spans, n):
    picks = [ids(sm.sample_n(spans.repartition(p), n, ["span_id"], 4)) for p in (1, 7)]
    ranked = ids(sm.sample_n(spans, F.lit(n), ["span_id"], 4))
    assert picks[0] == picks[1] == ranked and len(picks[0]) == min(n, 600)


def test_groups_are_even(spans):
    sizes = [r["count"] for r in sm.screening_groups(spans, 7, ["span_id"]).groupBy("screening_group").count().orderBy("screening_group").collect()]
    assert sizes == [86] * 5 + [85] * 2
    assert sm.screening_groups(spans.limit(2), 5, ["span_id"]).select("screening_group").distinct().count() == 2


def test_splits_are_disjoint(spark):
    persons = spark.range(400).select(F.col("id").alias("person_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("hospital_group"))
    persons = persons.unionByName(persons.filter("person_id < 10").withColumn("hospital_group", F.lit("B")))
    rows = sm.split_persons(persons, {"A": [("dev", 50), ("test_a", 25), ("train", 500)], "B": [("test_b", 25)]}).collect()
    assert len({r.person_id for r in rows}) == len(rows)
    sizes = {s: sum(r.split == s for r in rows) for s in ("dev", "test_a", "train", "test_b")}
    assert sizes == {"dev": 50, "test_a": 25, "train": 125, "test_b": 25}


@pytest.mark.parametrize("scale", [150, 500])
def test_proximity_weight_equals_brute_force(spans, scale):
    flagged = sm.threshold_flags(spans, "biopsy_procedure_1", (0.5, 0.8))
    rows = sm.proximity_weight(flagged, scale=scale).collect()
    positives = [(r.note_id, r.start) for r in rows if r.is_positive]
    for r in rows[:150]:
        near = sum(math.exp(-0.5 * ((r.start - s) / scale) ** 2) / (scale * math.sqrt(2 * math.pi)) for n, s in positives if n == r.note_id)
        assert abs(r.weight - near - 1e-5) < 1e-12


def test_weighted_sample_both_paths(spans):
    weighted = spans.withColumn("w", F.col("biopsy_procedure_1") + 0.01)
    limited = ids(sm.weighted_sample(weighted, 90, ["span_id"], "w", 3))
    ranked = ids(sm.weighted_sample(weighted.repartition(7), F.lit(90), ["span_id"], "w", 3))
    assert limited == ranked and len(limited) == 90
    assert sm.weighted_sample(weighted, None, ["span_id"], "w").count() == 600
    assert sm.weighted_sample(weighted, 10**6, ["span_id"], "w").count() == 600
    heavy = spans.withColumn("w", F.when(F.col("note_id") == 1, 1000.0).otherwise(0.001))
    assert {r.note_id for r in sm.weighted_sample(heavy, 100, ["span_id"], "w").collect()} == {1}


def test_negatives(spans):
    out = sm.sample_negatives(spans, "biopsy_procedure_1", 40, thresholds=(0.3, 0.99))
    assert out.count() == 40 and out.columns == spans.columns
    assert out.filter("biopsy_procedure_1 > 0.3").count() == 0
    none = sm.sample_negatives(spans.withColumn("biopsy_procedure_1", F.lit(0.1)), "biopsy_procedure_1", 40)
    assert none.count() == 0
    free = sm.sample_negatives(spans.withColumn("biopsy_procedure_1", F.lit(0.1)), "biopsy_procedure_1", 40, only_notes_with_positives=False)
    assert free.count() == 40


@pytest.mark.parametrize("n", [0, 7, 2000])
def test_oversample(spans, n):
    few = spans.limit(30)
    rows = sm.oversample(few, n, ["span_id"], 3).collect()
    assert len(rows) == n and len({(r.span_id, r.draw) for r in rows}) == n
    again = sm.oversample(few.repartition(5), F.lit(n), ["span_id"], 3)
    assert ids(again) == sorted(r.span_id for r in rows)


def test_oversample_lists_copies_in_steps(spans, monkeypatch):
    monkeypatch.setattr(sm, "COPY_STEP", 4)
    rows = sm.oversample(spans.limit(2), 41, ["span_id"], 1).collect()
    assert len({(r.span_id, r.draw) for r in rows}) == 41


def test_copies_of_few_rows_are_made_by_many_tasks(spans, monkeypatch):
    monkeypatch.setattr(sm, "COPY_STEP", 10)
    monkeypatch.setattr(sm, "COPY_TASK", 100, raising=False)
    drawn = sm.oversample(spans.limit(3), 2000, ["span_id"], 1)
    per_task = [r["count"] for r in drawn.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 2000 and max(per_task) < 600


def test_instance_ids(spans):
    assert sorted(r.instance_id for r in sm.add_instance_id(spans, ["span_id"], dense=True).collect()) == list(range(600))
    assert sm.add_instance_id(spans, ["span_id"]).select("instance_id").distinct().count() == 600


@pytest.mark.parametrize("strategy,positives,negatives", [("subsampling", 20, 30), (None, 20, None), ("oversampling", None, None)])
def test_selection(spans, strategy, positives, negatives):
    rows = se.select_training_data(
        spans, "Biopsy (procedure)", max_positives=20, thresholds=(0.3, 0.9), ratio=1.5, strategy=strategy, extra=("biopsy_procedure",)
    )
    counts = {r.is_positive: r["count"] for r in rows.groupBy("is_positive").count().collect()}
    available = spans.filter("biopsy_procedure_1 <= 0.3").join(spans.filter("biopsy_procedure_1 > 0.9").select("note_id").distinct(), "note_id", "left_semi").count()
    assert counts[False] == (negatives or available)
    assert counts[True] == (positives or int(1.5 * available))
    assert rows.select("instance_id").distinct().count() == rows.count()
    again = se.select_training_data(
        spans.repartition(7), "Biopsy (procedure)", max_positives=20, thresholds=(0.3, 0.9), ratio=1.5, strategy=strategy, extra=("biopsy_procedure",)
    )
    assert ids(again, "instance_id") == ids(rows, "instance_id")


def test_selection_without_positives(spans):
    rows = se.select_training_data(spans.withColumn("biopsy_procedure_1", F.lit(0.2)), "Biopsy (procedure)")
    assert rows.count() == 0


def test_dataset_round_trip_and_blocks(spark, spans):
    notes = spark.createDataFrame([(k, f"text {k}", k * 2) for k in range(1, 12)], "note_id long, note_text string, person_id long")
    dataset = ds.build_dataset(notes, spans, ["span_id"])
    assert dataset.count() == spans.select("note_id").distinct().count()
    assert ids(ds.read_dataset(dataset, ["span_id"])) == ids(spans)
    blocks = ds.build_dataset(notes, spans, ["span_id"], block_chars=5000)
    assert blocks.count() > dataset.count() and ids(ds.read_dataset(blocks, ["span_id"])) == ids(spans)


def test_task_dataset_and_card(spark, spans):
    notes = spark.createDataFrame([(k, f"text {k}", k * 2) for k in range(1, 12)], "note_id long, note_text string, person_id long")
    dataset, card = se.task_dataset(spans, notes, "Biopsy (procedure)", max_positives=10, thresholds=(0.5, 0.9))
    row = card.first()
    assert (row.n_positive_examples, row.n_negative_examples, row.n_entities) == (10, 10, 20)
    assert dataset.selectExpr("sum(size(entities))").first()[0] == 20


def test_drawn_copies_are_spread_over_rows(spark, spans):
    notes = spark.createDataFrame([(1, "t")], "note_id long, note_text string")
    drawn = sm.oversample(spans.filter("note_id = 1").limit(1), 23, ["span_id"])
    assert ds.build_dataset(notes, drawn, ["span_id"], draw="draw").count() == 1  # by default one row per note
    dataset = ds.build_dataset(notes, drawn, ["span_id"], draw="draw", block_copies=5)
    assert dataset.count() == 5 and ds.read_dataset(dataset).count() == 23


def test_merge_tasks_keeps_the_first_universe_and_null_keys(spark):
    a = spark.createDataFrame([(1, None, True), (2, "c", False)], "note_id int, context string, t1 boolean")
    b = spark.createDataFrame([(1, None, "1"), (3, "d", "1")], "note_id int, context string, t2 string")
    rows = ds.merge_tasks({"t1": a, "t2": b}, ["note_id", "context"]).orderBy("note_id").collect()
    assert [(r.note_id, r.t1, r.t2) for r in rows] == [(1, "1", "1"), (2, "0", None)]


def test_fingerprint_ignores_layout(spark, spans):
    first = ds.fingerprint(spans).first()
    assert first == ds.fingerprint(spans.repartition(7).select(*reversed(spans.columns))).first()
    assert first != ds.fingerprint(spans.limit(599)).first()
    gr.assert_unique_key(spans, ["span_id"])
