"""Models, summaries and metrics on counted vote patterns, and the way from votes to training sets."""

import math
import random
from itertools import combinations
from statistics import median

import pytest
from pyspark.sql import functions as F

from clinspark.operators import label_models as lm
from clinspark.plans import labelling as lb, selection as se

TASKS = {"A (procedure)": ["f0", "f1", "f2", "f3"], "B": ["f1", "f2"], "C": ["f4"]}


@pytest.fixture(scope="module")
def votes(spark):
    """Random votes of every kind, notes without any vote, and a gold column per task."""
    rng = random.Random(11)
    rows = []
    for i in range(800):
        truth = rng.random() < 0.3
        text = lambda right: None if rng.random() < 0.5 else ("A (procedure)" if truth == (rng.random() < right) else "B")
        silent = i % 40 == 0
        rows.append(
            (i, i, f"w{i % 7}", i * 10, i * 10 + 4, f"s{i}", None if silent else text(0.9), None if silent else text(0.8), None if silent else text(0.7),
             None if silent else [None, ["A (procedure)"], ["B", "C"]][rng.randint(0, 2)], None if silent else rng.choice([None, True, False]), truth, truth ^ (rng.random() < 0.2), i % 5 == 0)
        )
    names = "note_id long, person_id long, lexical_variant string, start int, end int, span_id string, f0 string, f1 string, f2 string, f3 array<string>, f4 boolean, gold_a boolean, gold_b boolean, gold_c boolean"
    return spark.createDataFrame(rows, names)


def codes_of(row, task, lfs, fill_negative):
    out = []
    for lf in lfs:
        v = row[lf]
        if isinstance(v, list) or lf == "f3":
            out.append(2 if v and task in v else 0)
        elif v is None:
            out.append(1 if fill_negative else 0)
        elif isinstance(v, bool):
            out.append(2 if v else 1)
        else:
            out.append(2 if v == task else 0)
    return out


def silent(row, task, lfs):
    return all((task not in (row[lf] or [])) if lf == "f3" else row[lf] is None for lf in lfs)


def sign(code):
    return {2: 1, 1: -1}.get(code, 0)


def plain_triplet(rows, m):
    def moment(i, j):
        pairs = [sign(r[i]) * sign(r[j]) for r in rows if sign(r[i]) and sign(r[j])]
        return sum(pairs) / len(pairs) if pairs else None

    out = []
    for i in range(m):
        ratios = []
        for j, k in combinations([x for x in range(m) if x != i], 2):
            a, b, c = moment(i, j), moment(i, k), moment(j, k)
            if None not in (a, b, c) and c:
                ratios.append(math.sqrt(abs(a * b / c)))
        out.append(min(max(median(ratios) if ratios else 0.5, 0.05), 0.95))
    return out


def plain_p(codes, accuracies, share):
    odds = math.log(share / (1 - share)) + sum(sign(c) * math.log((1 + a) / (1 - a)) for c, a in zip(codes, accuracies))
    return 1 / (1 + math.exp(-odds))


def plain_em(rows, m, share):
    a = [0.4] * m
    for _ in range(30):
        p = [plain_p(r, a, share) for r in rows]
        new = []
        for i in range(m):
            right = sum(x if sign(r[i]) == 1 else 1 - x for r, x in zip(rows, p) if sign(r[i]))
            voted = sum(1 for r in rows if sign(r[i]))
            new.append(min(max(2 * (right + 1) / (voted + 2) - 1, -0.95), 0.95))
        done = max(abs(x - y) for x, y in zip(a, new)) < 1e-4
        a = new
        if done:
            break
    return a


@pytest.mark.parametrize("method", ["triplet", "em"])
def test_pipeline_of_several_tasks(votes, method):
    dev = votes.filter("note_id < 300")
    gold = {"A (procedure)": "gold_a", "B": "gold_b", "C": "gold_c"}
    run = lb.label_pipeline(votes, TASKS, dev, gold, method, shares=0.2, min_support_dev=70)
    rows, dev_rows = votes.collect(), dev.collect()
    metrics = {r["task"]: r for r in run.metrics.collect()}
    labels = {r["span_id"]: r for r in run.labels.collect()}
    assert len(labels) == 800 and {"note_id", "person_id", "span_id", "start", "end"} <= set(run.labels.columns)
    for task, lfs in TASKS.items():
        kept = [codes_of(r, task, lfs, True) for r in rows if not silent(r, task, lfs)]
        positives = [r[gold[task]] for r in dev_rows]
        share = sum(positives) / len(positives) if sum(positives) >= 70 else 0.2
        assert run.shares[task] == pytest.approx(share)
        want = plain_triplet(kept, len(lfs)) if method == "triplet" else plain_em(kept, len(lfs), share)
        assert [run.accuracies[task][lf] for lf in lfs] == pytest.approx(want, abs=1e-9)
        name = {"A (procedure)": "a_procedure", "B": "b", "C": "c"}[task]
        p = {r["span_id"]: plain_p(codes_of(r, task, lfs, True), want, share) for r in rows}
        assert all(labels[s][f"{name}_1"] == pytest.approx(v, abs=1e-9) for s, v in p.items())
        called = [p[r["span_id"]] > 0.5 for r in dev_rows]
        hits = sum(c and g for c, g in zip(called, positives))
        m = metrics[task]
        assert (m["support"], m["instances"]) == (sum(positives), 300)
        assert m["precision"] == pytest.approx(hits / sum(called) if sum(called) else 0.0)
        assert m["recall"] == pytest.approx(hits / sum(positives))
        assert m["fscore"] == pytest.approx(2 * hits / (sum(called) + sum(positives)))
        assert m["count_positives"] == sum(v >= 0.5 for v in p.values()) and m["count_negatives"] == sum(v < 0.5 for v in p.values())


def test_pattern_summary_equals_the_summary_of_spans(votes):
    task, lfs = "A (procedure)", TASKS["A (procedure)"]
    gold = F.when(F.col("gold_a"), 2).otherwise(1)
    matrix = lm.label_matrix(votes, task, lfs, fill_negative=["f0"]).withColumn("gold", gold)
    patterns = lm.vote_patterns(matrix, {task: lfs}, 1, 2, gold={task: F.col("gold")})
    got = lm.pattern_summary(patterns, {task: lfs}, 1, 2, True).drop("task").orderBy("lf").collect()
    want = lm.lf_summary(matrix, lfs, 0, "gold").orderBy("lf").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert patterns.agg(F.sum("n")).first()[0] == 800 and patterns.count() < 150


def test_pipeline_edges(spark, votes):
    empty = votes.limit(0)
    run = lb.label_pipeline(empty, TASKS, method="em")
    assert run.labels.count() == 0 and run.metrics.count() == 3 and run.summary_dev is None
    assert {r["polarity"] for r in run.summary_train.collect()} == {""}
    none = lb.label_pipeline(votes, {**TASKS, "D": []}, method="triplet", shares=0.25)
    assert none.labels.filter(F.abs(F.col("d_1") - 0.25) > 1e-12).count() == 0
    majority = lb.label_pipeline(votes, TASKS, votes, {t: "gold_a" for t in TASKS}, "majority")
    assert majority.accuracies == {} and majority.metrics.filter("support is null").count() == 0
    with pytest.raises(ValueError):
        lb.label_pipeline(votes, TASKS, votes, {"B": "gold_b"})
    with pytest.raises(ValueError):
        lb.label_pipeline(votes, TASKS, method="magic")


def test_rescaling_is_asked_for(votes):
    plain = lb.label_tasks(votes, TASKS, "em", shares=0.01, fillnone_as_negative=True)
    scaled = lb.label_tasks(votes, TASKS, "em", shares=0.01, fillnone_as_negative=True, rescale=True)
    for name in ("a_procedure", "b", "c"):
        low, high = (df.agg(F.max(f"{name}_1")).first()[0] for df in (plain, scaled))
        assert high == pytest.approx(1.0 if low < 0.5 else low)


@pytest.mark.parametrize("strategy", ["subsampling", "oversampling", None])
@pytest.mark.parametrize("method", ["majority", "triplet"])
def test_training_set_from_labels(spark, votes, strategy, method):
    """The output of the label model goes into the training set as it is, probability maps included."""
    notes = votes.select("note_id", "person_id", F.concat(F.lit("text "), "note_id").alias("note_text"))
    labels = lb.label_tasks(votes, TASKS, method, shares=0.3)
    dataset, card = se.task_dataset(labels, notes, "A (procedure)", max_positives=25, only_notes_with_positives=False, strategy=strategy)
    entities = dataset.select("note_id", F.explode("entities").alias("e")).select("note_id", "e.*").collect()
    row = card.first()
    assert len(entities) == row["n_positive_examples"] + row["n_negative_examples"] == row["n_entities"] > 25
    p = {(r["note_id"], r["start"]): r["a_procedure_1"] for r in labels.collect()}
    assert all(e["a_procedure"]["1"] == p[e["note_id"], e["start_char"]] for e in entities)
    assert sum(e["a_procedure"]["1"] > 0.5 for e in entities) == row["n_positive_examples"]


def test_sorted_entities_with_maps(spark):
    from clinspark.operators.datasets import build_dataset

    rows = [(1, 5, 9, "b", {"1": 0.2}), (1, 0, 3, "a", {"1": 0.9}), (1, 5, 9, "b", {"1": 0.1}), (1, 5, 7, "c", None)]
    spans = spark.createDataFrame(rows, "note_id long, start int, end int, lexical_variant string, p map<string,double>")
    notes = spark.createDataFrame([(1, "text")], "note_id long, note_text string")
    got = build_dataset(notes, spans, ["p"]).first()["entities"]
    assert [(e["start_char"], e["end_char"], e["p"]) for e in got] == [(0, 3, {"1": 0.9}), (5, 7, None), (5, 9, {"1": 0.1}), (5, 9, {"1": 0.2})]
