import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from clinspark.operators import label_models as lm, lfs
from clinspark.operators.spans import ContextWindow
from clinspark.plans import labelling as lb

VOTES = [(1, 1, None, None, None), (2, 1, "A", None, ["B", "A"]), (3, 2, None, None, ["B"]), (4, 3, "A", "A", ["A"])]


@pytest.fixture(scope="module")
def votes(spark):
    return spark.createDataFrame(VOTES, "id int, note_id int, lf_1 string, lf_2 string, lf_3 array<string>")


def test_label_matrix_golden(votes):
    rows = lm.label_matrix(votes, "A", ["lf_1", "lf_2", "lf_3"], -1, 1, 0, fill_negative=["lf_2"]).orderBy("id").collect()
    assert [(r.lf_1, r.lf_2, r.lf_3) for r in rows] == [(0, -1, 0), (1, -1, 1), (0, -1, 0), (1, 1, 1)]


def test_label_matrix_drops_notes_without_votes(votes):
    rows = lm.label_matrix(votes, "A", ["lf_1", "lf_2", "lf_3"], drop_all_abstaining=True).collect()
    assert {r.note_id for r in rows} == {1, 3}


def test_label_matrix_booleans_and_other_tasks(spark):
    df = spark.createDataFrame([(True, "B"), (False, "A"), (None, None)], "b boolean, s string")
    rows = lm.label_matrix(df, "A", ["b", "s"]).collect()
    assert [(r.b, r.s) for r in rows] == [(2, 0), (1, 2), (0, 0)]


def test_majority_golden(spark):
    df = spark.createDataFrame([(0, 0, -1), (-1, 0, 1), (1, -1, 0), (-1, -1, -1)], "a int, b int, c int")
    rows = lm.majority_vote(df, ["a", "b", "c"]).collect()
    assert [(r.prob_0, r.prob_1) for r in rows] == [(1, 0), (0.5, 0.5), (0.5, 0.5), (0.5, 0.5)]
    with pytest.raises(ValueError):
        lm.majority_vote(df, ["a"], abstention=5)


def test_majority_label_ties(spark):
    df = spark.range(400).select("id", F.lit(0.5).alias("prob_0"), F.lit(0.5).alias("prob_1"))
    first = lm.majority_label(df, ["id"], classes=(1, 2), seed=1)
    again = lm.majority_label(df.repartition(7), ["id"], classes=(1, 2), seed=1)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    share = first.filter("label_majority = 2").count() / 400
    assert 0.4 < share < 0.6
    assert lm.majority_label(df, ["id"], classes=(1, 2), tie_class=1).filter("label_majority <> 1").count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    """Votes drawn from known accuracies."""
    rng = random.Random(5)
    accuracies = [0.9, 0.8, 0.75, 0.7]
    rows = []
    for i in range(6000):
        y = 1 if rng.random() < 0.4 else -1
        rows.append((i, y, *[(y if rng.random() < a else -y) if rng.random() < 0.8 else 0 for a in accuracies]))
    return spark.createDataFrame(rows, "id int, y int, l0 int, l1 int, l2 int, l3 int"), accuracies


def test_triplet_and_em_recover_accuracies(planted):
    matrix, accuracies = planted
    names = ["l0", "l1", "l2", "l3"]
    triplet = lm.fitted_values(lm.triplet_fit(matrix, names))
    em = lm.fitted_values(lm.em_fit(matrix, names, 0.4))
    for lf, a in zip(names, accuracies):
        assert abs((1 + triplet[lf]) / 2 - a) < 0.08
        assert abs((1 + em[lf]) / 2 - a) < 0.05
    probs = lm.predict_probs(matrix, em, 0.4)
    right = probs.filter((F.col("prob_1") > 0.5) == (F.col("y") == 1)).count() / 6000
    assert right > 0.85
    assert probs.filter(F.abs(F.col("prob_0") + F.col("prob_1") - 1) > 1e-9).count() == 0


def test_triplet_without_triples_uses_the_default(spark):
    df = spark.createDataFrame([(1, 1)], "a int, b int")
    assert lm.fitted_values(lm.triplet_fit(df, ["a", "b"])) == {"a": 0.5, "b": 0.5}


def test_posterior_formula(spark):
    df = spark.createDataFrame([(1, -1)], "a int, b int")
    p = lm.predict_probs(df, {"a": 0.6, "b": 0.2}, 0.3).first().prob_1
    odds = math.log(0.3 / 0.7) + math.log(1.6 / 0.4) - math.log(1.2 / 0.8)
    assert abs(p - 1 / (1 + math.exp(-odds))) < 1e-12


def test_rescale(spark):
    df = spark.createDataFrame([(0.1,), (0.4,)], "p1 double").withColumn("p0", 1 - F.col("p1"))
    assert [r.p1 for r in lm.rescale_probs(df, "p1", "p0").orderBy("p1").collect()] == [0.25, 1.0]
    high = df.withColumn("p1", F.col("p1") + 0.5)
    assert [round(r.p1, 6) for r in lm.rescale_probs(high, "p1", "p0").orderBy("p1").collect()] == [0.6, 0.9]


def test_positive_share(spark):
    df = spark.createDataFrame([(2,), (1,), (1,), (1,)], "y int")
    assert lm.positive_share(df, "y", 2) == 0.25
    assert lm.positive_share(df, "y", 2, minimum_support=5) == lm.DEFAULT_POSITIVE_SHARE
    assert lm.positive_share(df, "y", 9) == lm.DEFAULT_POSITIVE_SHARE


@pytest.mark.parametrize("method", ["majority", "triplet", "em"])
def test_label_tasks(votes, method):
    rows = lb.label_tasks(votes, {"A": ["lf_1", "lf_2", "lf_3"]}, method, shares=0.5, keep=["id"]).collect()
    assert len(rows) == 4
    for r in rows:
        assert abs(r.a_0 + r.a_1 - 1) < 1e-9 and r.a == {"0": r.a_0, "1": r.a_1}
    by_id = {r.id: r.a_1 for r in rows}
    assert by_id[4] >= by_id[2] >= by_id[1]
    with pytest.raises(ValueError):
        lb.label_tasks(votes, {"A": ["lf_1"]}, "magic")


# ---------------------------------------------------------------- labelling functions


def test_logical_rules_in_order(spark):
    df = spark.createDataFrame(
        [(1, "X", ["Y"], None), (2, None, ["Z", "Y"], True), (3, "X", None, False)], "id int, a string, b array<string>, c boolean"
    )
    rules = [
        {"name": "r1", "lf_in": {"a": "X", "b": "Y"}, "relation": "a and b", "value_out": True},
        {"name": "r2", "lf_in": {"r1": True, "c": True}, "relation": "(r1 or c)", "value_out": "T"},
        {"name": "r3", "lf_in": {"r1": "X"}, "relation": "r1", "value_out": True},
        {"name": "r4", "lf_in": {"c": None}, "relation": "not c", "value_out": True},
    ]
    rows = lfs.logical_lfs(df, rules).orderBy("id").collect()
    assert [r.r1 for r in rows] == [True, None, None]
    assert [r.r2 for r in rows] == ["T", "T", None]
    assert [r.r3 for r in rows] == [None, None, None]
    assert [r.r4 for r in rows] == [None, True, True]
    lenient = lfs.logical_lfs(df, rules, lenient_bool=True).orderBy("id").collect()
    assert [r.r3 for r in lenient] == [True, None, None]


@pytest.mark.parametrize("relation", ["a; drop", "a and zzz", "a + b", "__import__('os')", "a.b"])
def test_relations_are_checked(relation):
    with pytest.raises(ValueError):
        lfs.relation_tokens(relation, ["a", "b"])


def test_number_votes_are_refused(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(TypeError):
        lfs.logical_lf(df, {"name": "r", "lf_in": {"a": "X"}, "relation": "a", "value_out": True})


def test_pattern_configuration():
    config = {
        "PET": {"lf_name": "lf_regex_1", "terms": {"p": ["TEP", "PET-TDM"]}, "context_sents": 1, "attr": "TEXT"},
        "Trial": {"lf_name": "lf_regex_2", "regex": {"r": ["inclus .{0,5} essai"]}, "context_sents": [1, 3], "attr": "NORM"},
        "Words": {"lf_name": "lf_regex_3", "terms": {"e": ["écho"]}, "context_words": [5, 5], "context_sents": 1, "attr": "NORM"},
        "No name": {"terms": {"x": ["y"]}},
        "Unknown": {"lf_name": "lf_x", "terms": {"x": ["y"]}},
    }
    found, skipped = lfs.parse_patterns(config, known_lfs=["lf_regex_1", "lf_regex_2", "lf_regex_3"])
    assert [f.name for f in found] == ["lf_regex_1", "lf_regex_2", "lf_regex_3"]
    assert skipped == [("No name", None), ("Unknown", "lf_x")]
    assert found[1].window.sentences == (0, 2) and found[1].window.norm
    assert found[2].window.words == (5, 5) and "echo" in found[2].regex()
    with pytest.raises(ValueError):
        lfs.parse_patterns(config, known_lfs=["lf_regex_1"], strict=True)


def test_terms_match_whole_words(spark):
    lf = lfs.PatternLF("v", "T", terms=("TEP", "a+b"), window=ContextWindow(sentences=1))
    df = spark.createDataFrame([("un TEP ici",), ("TEPscan",), ("éTEP",), ("x a+b.",), ("(TEP)",)], "context string")
    assert [r.v for r in lfs.pattern_lf(df, lf).collect()] == ["T", None, None, "T", "T"]


def test_apply_lfs_end_to_end(spark):
    day = datetime.date(2020, 3, 12)
    notes = spark.createDataFrame(
        [(1, 7, datetime.date(2020, 6, 1), "TEP le 12/03/2020. Biopsie en mai."), (2, 8, datetime.date(2020, 6, 1), "IRM le 12/03/2020")],
        "note_id long, person_id long, note_date date, note_text string",
    )
    events = spark.createDataFrame([(7, "lf_ccam", day, "PET"), (7, "lf_ccam", day, "Biopsy"), (7, "lf_drugs", day, "Chemo")], "person_id long, lf string, event_date date, class string")
    patterns = [lfs.PatternLF("lf_regex_1", "PET", terms=("TEP",)), lfs.PatternLF("lf_regex_10", "Biopsy", terms=("biopsie",), window=ContextWindow(sentences=1, norm=True))]
    rules = [{"name": "logical_lf1", "lf_in": {"lf_regex_1": "PET", "lf_ccam": "PET"}, "relation": "lf_regex_1 and lf_ccam", "value_out": True}]
    rows = lb.apply_lfs(notes, events, patterns, rules).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.lexical_variant, row.start, row.lf_regex_1, row.lf_regex_10) == ("12/03/2020", 7, "PET", None)
    assert row.lf_ccam == ["Biopsy", "PET"] and row.lf_drugs == ["Chemo"] and row.lf_icd10 is None and row.logical_lf1
    kept = lb.apply_lfs(notes, events, patterns, rules, how="left").collect()
    assert {r.note_id for r in kept} == {1, 2}
    with pytest.raises(ValueError):
        lb.apply_lfs(notes, None, patterns, known_lfs=["lf_regex_1"])


@pytest.mark.parametrize("threshold", [0, 1, 3])
@pytest.mark.parametrize("large_rows", [1, 10**9])
def test_temporal_votes_equal_brute_force(spark, threshold, large_rows):
    rng = random.Random(threshold)
    day = lambda: datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(25))
    spans = [(i, rng.choice([1, 1, 1, 2, 3]), day() if i % 9 else None) for i in range(120)]
    events = [(rng.choice([1, 2, 4]), day(), rng.choice("abc")) for _ in range(60)]
    s = spark.createDataFrame(spans, "id int, person_id long, span_date date")
    e = spark.createDataFrame(events, "person_id long, event_date date, class string")
    got = {r.id: r.v for r in lfs.external_lf(s, e, "v", threshold_days=threshold, rows_per_task=large_rows).collect()}
    for i, person, date in spans:
        want = sorted({c for p, d, c in events if date and p == person and abs((d - date).days) <= threshold}) or None
        assert got[i] == want
