"""Nothing is lost, and nothing multiplies, at the edges: nulls, repeated keys, long lists, maps, empty frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from clinspark.operators import datasets as ds, fhir, lfs, sampling as sm
from clinspark.operators.groups import key_loads, spread_join, with_group_totals
from clinspark.plans.cohort import patient_cohort
from clinspark.sources import tables as tb


def test_first_date_of_stays_without_dates(spark):
    schema = "person_id long, visit_occurrence_id long, visit_start_datetime timestamp, visit_source_value string, organ string, system string, weight_code double, care_site_id long, care_site_name string"
    day = datetime.datetime(2020, 1, 5)
    rows = [(1, 10, None, "x", "lung", "chest", 1.0, 1, "a"), (1, 11, day, "x", "lung", "chest", 1.0, 1, "a"), (2, 12, None, "x", "skin", "outer", 1.0, 1, "a")]
    stays = spark.createDataFrame(rows, schema)
    found = {r["person_id"]: r["localisation_first_date"] for r in patient_cohort(stays).collect()}
    assert found == {1: day, 2: None}
    assert [r["person_id"] for r in patient_cohort(stays, first_date_after="2019-01-01").collect()] == [1]


@pytest.mark.parametrize("extra", [0, 1100])
def test_nulls_in_value_lists(spark, extra):
    df = spark.createDataFrame([(1,), (2,), (None,)], "person_id long")
    values = [1, None, *range(10, 10 + extra)]
    assert [r[0] for r in tb.keep_avoid(df, avoid=values).collect()] == [2]
    assert [r[0] for r in tb.keep_avoid(df, keep=values).collect()] == [1]
    assert tb.keep_avoid(df, keep=[None]).count() == 0 and tb.keep_avoid(df, avoid=[None]).count() == 2


def test_list_items_all_get_columns(spark):
    df = spark.createDataFrame([((["x", "y"], [[1], [2, 3]]),), (([], None),), ((None, [[]]),)], "v struct<code: array<string>, n: array<array<int>>>")
    rows = [r.asDict() for r in fhir.flatten_struct(df, "v").collect()]
    assert rows[0] == {"code___0": "x", "code___1": "y", "n___0___0": 1, "n___0___1": None, "n___1___0": 2, "n___1___1": 3}
    assert all(v is None for r in rows[1:] for v in r.values())
    with pytest.raises(Exception, match="more than 1 items"):
        fhir.flatten_struct(df, "v", {"code": 1}).collect()


def test_repeated_keys_stop_the_job(spark):
    one = spark.createDataFrame([(1, 0, 5, "a")], "note_id long, start int, end int, lf_a string")
    two = spark.createDataFrame([(1, 0, 5, "b"), (1, 0, 5, "c")], "note_id long, start int, end int, lf_b string")
    for sets in ([one, two], [two, one]):
        with pytest.raises(Exception, match="not unique"):
            lfs.merge_votes(sets).collect()
    gold = two.select("note_id", "start", "end", F.lit("1").alias("task"))
    with pytest.raises(Exception, match="not unique"):
        lfs.votes_with_gold(one, gold, "task", 2, 1).collect()
    keys = ["note_id", "start", "end"]
    with pytest.raises(Exception, match="not unique"):
        ds.merge_tasks({"lf_a": one, "lf_b": two}, keys).collect()
    assert lfs.merge_votes([one, two.limit(1)]).count() == 1


def test_rows_with_maps_can_be_spread(spark):
    df = spark.createDataFrame([(k % 2, k, {"p": 0.5}) for k in range(20)], "person_id long, span_id long, scores map<string, double>")
    totals = with_group_totals(df, ["person_id"], large_rows=5, n=F.count(F.lit(1))).collect()
    assert len(totals) == 20 and {r["n"] for r in totals} == {10}
    right = spark.createDataFrame([(0, "a"), (1, "b")], "person_id long, name string")
    joined = spread_join(df, right, ["person_id"], key_loads(df, ["person_id"], 5)).collect()
    assert sorted((r["span_id"], r["name"]) for r in joined) == [(k, "ab"[k % 2]) for k in range(20)]


def test_oversampling_nothing(spark):
    empty = spark.createDataFrame([], "span_id string")
    assert sm.oversample(empty, 5, ["span_id"]).count() == 0
