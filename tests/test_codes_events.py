import pytest
from pyspark.sql import functions as F

from clinspark.operators import codes as cd, events as ev
from clinspark.plans import cohort as co

CODES = ["C", "C5", "C50", "C501", "C5012", "C50123", "C501234", "C5012345", "D3", "D"]


@pytest.fixture(scope="module")
def conditions(spark):
    values = ["C", "C5", "C50", "C501", "C5012", "C50123", "C501234", "C5012345", "D37", None]
    rows = [(i, v, "DP" if i % 2 else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "condition_occurrence_id long, condition_source_value string, condition_status_source_value string")


def or_form(listed):
    condition = F.lit(False)
    for n in (1, 3, 4, 5, 6, 7):
        condition = condition | (F.col("code") == F.substring("condition_source_value", 1, n))
    return condition


def test_prefix_join_equals_the_or_form(spark, conditions):
    listed = spark.createDataFrame([(c, i) for i, c in enumerate([*CODES, "C50"])], "code string, task int")
    want = conditions.join(listed, or_form(listed)).select("condition_occurrence_id", "task")
    got = cd.match_prefix_codes(conditions, listed, "condition_source_value").select("condition_occurrence_id", "task")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_two_characters_never_match_a_longer_code(conditions):
    got = {r.condition_source_value for r in ev.select_conditions(conditions, ["C5"]).collect()}
    assert got == {"C5"}
    assert {r.condition_source_value for r in ev.select_conditions(conditions, "C5012345").collect()} == set()


def test_code_dispatch(spark, conditions):
    assert ev.select_conditions(conditions, None).count() == 10
    assert ev.select_conditions(conditions, ("D",)).count() == 1
    empty = spark.createDataFrame([], "code string, task int")
    assert ev.select_conditions(conditions, empty).count() == 0
    with pytest.raises(TypeError):
        ev.select_conditions(conditions, 3.5)
    with pytest.raises(TypeError):
        cd.filter_codes(conditions, {"a": 1}, "condition_source_value")
    with pytest.raises(TypeError):
        ev.filter_status(conditions, 4)
    assert ev.filter_status(conditions, []).count() == 10
    assert ev.filter_status(conditions, "DP").count() == 5


def test_duplicate_list_rows_multiply_and_can_be_dropped(spark, conditions):
    listed = spark.createDataFrame([("C50", 1), ("C50", 2)], "code string, task int")
    assert ev.select_conditions(conditions, listed).count() == 12
    assert ev.select_conditions(conditions, listed, drop_duplicates=True).count() == 6


def test_sources(spark):
    df = spark.createDataFrame([(1, "url-a"), (2, "url-b")], "id int, cdm_source string")
    sources = {"A": "url-a", "B": "url-b"}
    assert [r.id for r in cd.filter_source(df, "A", sources).collect()] == [1]
    assert [r.id for r in cd.filter_source(df, "url-b", sources).collect()] == [2]
    assert cd.filter_source(df, None, sources).count() == 2
    with pytest.raises(ValueError):
        cd.filter_source(df, "C", sources)


def test_person_sets(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "person_id long")
    assert cd.filter_persons(df, None).count() == 4
    assert cd.filter_persons(df, [2, 2]).count() == 2
    assert cd.filter_persons(df, [2], "leftanti").count() == 2
    assert cd.filter_persons(df, []).count() == 0
    assert cd.filter_persons(df, [], "left_anti").count() == 4
    with pytest.raises(ValueError):
        cd.filter_persons(df, [1], "cross")


def test_notes_imaging_and_drug_validation(spark):
    notes = spark.createDataFrame([(1, "2020-01-01", [5, 6]), (2, "2020-01-02", [7])], "person_id long, note_date string, note_class_concept_id array<long>")
    listed = spark.createDataFrame([(5, 1), (6, 1), (7, 2)], "concept_id long, task_id int")
    assert ev.select_notes(notes, listed).count() == 2
    assert ev.select_notes(notes, 7).count() == 1
    assert ev.select_notes(notes, [6, 9]).count() == 1
    imaging = spark.createDataFrame([(1, None, 3, 4)], "person_id long, series_datetime timestamp, modality_concept_id long, modality_source_concept_id long")
    assert ev.select_imaging(imaging, 4, "SOURCE", convert_to_date=False).count() == 1
    with pytest.raises(ValueError):
        ev.select_imaging(imaging, 4, "OTHER")
    with pytest.raises(ValueError):
        ev.select_drugs(imaging, imaging, [1], retrieve_by="shape")
    with pytest.raises(ValueError):
        ev.select_drugs(imaging, imaging, [1], vocabulary="X")


def test_costs(spark):
    costs = spark.createDataFrame([(1, 10, "G1", "s"), (1, 10, "G1", "s"), (2, 11, "G2", "s")], "cost_id long, cost_event_id long, drg_source_value string, cdm_source string")
    rows = ev.select_costs(costs, ["G1", "G2"], drop_duplicates=True)
    assert sorted(r.visit_occurrence_id for r in rows.collect()) == [10, 11]


def test_steps_are_validated_and_step_five_needs_costs(spark):
    hits = spark.createDataFrame([(1, "list_1", "DP"), (2, "list_1", "DR"), (3, "list_4d", "DAS"), (3, "list_4a", None)], "visit_occurrence_id long, list string, status string")
    assert {(r.visit_occurrence_id, r.step_1, r.step_4) for r in co.stay_steps(hits).collect()} == {(1, True, False), (3, False, True)}
    one = co.stay_steps(hits, steps=[4]).filter("stay_cancer").collect()
    assert [r.visit_occurrence_id for r in one] == [3]
    with pytest.raises(ValueError):
        co.stay_steps(hits, steps=[5])
    costs = spark.createDataFrame([(9,)], "visit_occurrence_id long")
    assert 9 in {r.visit_occurrence_id for r in co.stay_steps(hits, steps=[1, 5], costs=costs).collect()}


def test_flag_lists(spark):
    flags = spark.createDataFrame([("A1", "x", None), ("A2", None, "x"), ("A3", "y", "x")], "Code string, Liste_1 string, Liste_4_A string")
    assert {tuple(r) for r in cd.step_code_lists(flags).collect()} == {("list_1", "A1"), ("list_4a", "A2"), ("list_4a", "A3")}


def scans(df):
    """How many files sources the executed plan reads."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0].count("FileScan parquet")


def test_dictionary_spares_the_events(spark, conditions, tmp_path):
    """Only the codes in use are exploded; a given dictionary leaves one read of the events; codes that it lacks match nothing."""
    path = str(tmp_path / "conditions")
    conditions.write.parquet(path)
    events = spark.read.parquet(path)
    listed = spark.createDataFrame([(c, i) for i, c in enumerate(CODES)], "code string, task int")
    whole = cd.match_prefix_codes(events, listed, "condition_source_value")
    known = spark.createDataFrame([(c,) for c in [*CODES, "C50", "Z"]], "full_code string")
    given = cd.match_prefix_codes(events, listed, "condition_source_value", dictionary=known)
    assert scans(given) == 1
    rows = sorted(map(tuple, whole.collect()), key=str)
    assert rows == sorted([tuple(r) for r in given.collect()] + [tuple(r) for r in whole.filter("condition_source_value = 'D37'").collect()], key=str)
    few = cd.match_prefix_codes(events, listed, "condition_source_value", dictionary=known.filter("full_code = 'C50'"))
    assert {r["condition_source_value"] for r in few.collect()} == {"C50"}


def test_steps_and_places_from_one_read(spark, tmp_path):
    """The combined form against hits, steps and localisations on their own, over random claims with nulls and repeated rows."""
    import random

    rng = random.Random(6)
    codes = ["A10", "A101", "A2", "B30", "B301", "B30123", "C", "C401", "C4", None]
    diagnoses = [(rng.choice([*range(60), None]), rng.choice(codes), rng.choice(["DP", "DR", "DAS", "X", None])) for _ in range(500)]
    acts = [(rng.randint(0, 70), rng.choice(["P1", "P2", "P3", None])) for _ in range(80)]
    path = str(tmp_path / "conditions")
    spark.createDataFrame(diagnoses, "visit_occurrence_id long, condition_source_value string, condition_status_source_value string").write.parquet(path)
    conditions = spark.read.parquet(path)
    procedures = spark.createDataFrame(acts, "visit_occurrence_id long, procedure_source_value string")
    listed = [("list_1", "A10"), ("list_1", "A10"), ("list_1_radiotherapy", "B"), ("list_2", "B30"), ("list_3", "C"), ("list_4d", "C401"), ("list_4d", "A2"), ("list_4a", "P1"), ("other", "A10")]
    lists = spark.createDataFrame(listed, "list string, code string")
    places = [("A10", "s1", "o1"), ("A101", "s1", "o2"), ("B30", "s2", "o3"), ("B", "s3", "o3"), ("C4", None, "o4"), ("B301", "s2", None)]
    localisations = spark.createDataFrame(places, "code string, system string, organ string")
    costs = spark.createDataFrame([(3,), (99,), (99,)], "visit_occurrence_id long")
    for level in ("organ", "system"):
        got = co.located_steps(conditions, procedures, lists, localisations, (1, 3, 5), level, costs, spark.createDataFrame([(c,) for c in codes if c], "full_code string"))
        apart = co.add_localisation(co.stay_steps(co.list_hits(conditions, procedures, lists), (1, 3, 5), costs), conditions, localisations, level)
        columns = sorted(apart.columns)
        assert sorted(got.columns) == columns
        rows, want = (sorted((tuple(r) for r in df.filter("visit_occurrence_id is not null").select(columns).collect()), key=str) for df in (got, apart))
        assert rows == want
        assert len(rows) > 20 and scans(got) == 1
    with pytest.raises(ValueError):
        co.located_steps(conditions, procedures, lists, localisations, (5,))


def test_a_larger_file_is_spread_over_more_tasks(spark, sf_dir, monkeypatch):
    from queries import adapters as ad

    lines = ad.table(spark, sf_dir, "lineitem")
    few = ad.spread_few_files(lines, ["l_orderkey"])
    monkeypatch.setattr(ad, "SPREAD_BYTES", 4096)
    many = ad.spread_few_files(lines, ["l_orderkey"])
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < many.rdd.getNumPartitions()
    assert many.count() == lines.count()
