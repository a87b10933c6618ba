import random

import pytest
from pyspark.sql import Window, functions as F

from clinspark.operators import groups as gr


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, some keys are null, some rows share their order value."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None]), rng.randrange(40), float(i % 7)) for i in range(900)]
    return spark.createDataFrame(rows, "id long, key string, at int, value double")


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("large_rows", [1, 200, 10**9])
def test_group_totals_equal_a_window(skewed, partitions, large_rows):
    window = Window.partitionBy("key")
    want = skewed.select("*", F.sum("value").over(window).alias("s"), F.count("*").over(window).alias("n"))
    got = gr.with_group_totals(skewed.repartition(partitions), ["key"], large_rows, s=F.sum("value"), n=F.count(F.lit(1)))
    assert rows_of(got) == rows_of(want)


def test_group_totals_spread_large_groups(skewed):
    plan = gr.with_group_totals(skewed, ["key"], 1, n=F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "_spread" in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("large_rows", [1, 7, 250, 10**9])
def test_spread_join_equals_a_left_join(spark, skewed, large_rows):
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("zzz", 3), (None, 4)], "key string, extra int")
    loads = gr.key_loads(skewed, ["key"], large_rows)
    want = skewed.join(right, "key", "left").select(*skewed.columns, "extra")
    assert rows_of(gr.spread_join(skewed, right, ["key"], loads)) == rows_of(want)


def test_every_loaded_key_is_spread(spark):
    """Thousands of keys with many rows each, more than the library names in any constant for a plain frame of keys."""
    df = spark.range(60_000).select((F.col("id") % 12_000).alias("key"), "id")
    loads = gr.key_loads(df, ["key"], 2)
    assert loads.count() == gr.LARGEST_GROUPS and loads.filter("_copies <> 3").count() == 0
    right = spark.range(0, 12_000, 2).select(F.col("id").alias("key"), (F.col("id") * 7).alias("extra"))
    got = gr.spread_join(df, right, ["key"], loads)
    assert got.count() == 60_000 and got.filter("extra is null and key % 2 = 0 or extra <> key * 7").count() == 0


def test_rows_of_a_hot_key_go_to_several_tasks(spark):
    """One key with a third of the rows: no shuffle partition holds more than a few parts of it; rows without a key are spread as well."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.col("id")).alias("key"), "id")
    loads = gr.key_loads(df.filter("key is not null"), ["key"], 500)
    assert [tuple(r) for r in loads.collect()] == [(-1, 20)]
    right = spark.createDataFrame([(-1, 5)], "key long, extra int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = gr.spread_join(df, right, ["key"], loads).withColumn("task", F.spark_partition_id())
        largest = joined.groupBy("task").count().agg(F.max("count"), F.sum("count")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert largest[1] == 30_000 and largest[0] < 0.4 * 30_000


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("upto", [None, 1, 250, 5000])
def test_hash_rank_is_dense_and_repeatable(skewed, partitions, upto):
    ranked = gr.hash_rank(skewed.repartition(partitions), ["id"], 5, "rank", upto=upto)
    ranks = {r["id"]: r["rank"] for r in ranked.collect()}
    n = 900 if upto is None else min(upto, 900)
    assert sorted(ranks.values()) == list(range(1, n + 1))
    again = {r["id"]: r["rank"] for r in gr.hash_rank(skewed.repartition(3), ["id"], 5, "rank", upto=upto).collect()}
    assert ranks == again


def test_ordered_rank_within_keys(skewed):
    window = Window.partitionBy("key").orderBy("at", "id")
    want = skewed.select("id", F.row_number().over(window).alias("rank"))
    got = gr.ordered_rank(skewed.filter("key is not null"), F.col("at"), [F.col("at"), F.col("id")], "rank", within=["key"])
    assert rows_of(got.select("id", "rank")) == rows_of(want.join(skewed.filter("key is not null").select("id"), "id"))


def test_keep_n_takes_first_and_last_with_ties(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 7, "c"), (2, 1, "d")], "person_id int, day int, tag string")
    first = gr.keep_one(df, sort_column="day", tie_break=["tag"])
    last = gr.keep_n(df, sort_column="day", how="anything", n=2, tie_break=["tag"])
    assert rows_of(first) == [(1, 5, "a"), (2, 1, "d")]
    assert rows_of(last) == [(1, 5, "a"), (1, 7, "c"), (2, 1, "d")]
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()


def test_dedupe_is_repeatable(skewed):
    picks = [rows_of(gr.dedupe_on(skewed.repartition(p), ["key"], ["at"])) for p in (1, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == 5


def test_unique_key_check(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id int, tag string")
    assert gr.assert_unique_key(df, ["id"]) is df
    with pytest.raises(ValueError):
        gr.assert_unique_key(df, ["tag"])


@pytest.mark.parametrize("n,block", [(1, 3), (4, 4), (4, 10), (9, 100)])
@pytest.mark.parametrize("partial", [True, False])
def test_rolling_mean_over_blocks(skewed, n, block, partial):
    df = skewed.filter("key is not null")
    window = Window.partitionBy("key").orderBy("at", "id").rowsBetween(-(n - 1), 0)
    mean = F.avg("value").over(window)
    want = df.select("id", F.round(mean if partial else F.when(F.count("*").over(window) == n, mean), 9).alias("m"))
    got = gr.rolling_mean(df, "value", ["key"], ["at", "id"], n, partial, block=block)
    assert rows_of(got.select("id", F.round("rolling_mean", 9).alias("m"))) == rows_of(want)


@pytest.mark.parametrize("partitions", [1, 5])
def test_a_long_series_is_cut_into_ranges(spark, partitions):
    """One series holds a third of the rows and all of them at one time of day; ranks are exact and no range holds it whole."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("key"), F.lit(1).alias("at"), "id")
    df = df.withColumn("value", F.pmod(F.col("id") * 37, F.lit(11)).cast("double"))
    ranked = gr.series_rank(df.repartition(partitions), ["key"], ["at", "id"], "rank")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("at", "id")).cast("bigint"))
    assert rows_of(ranked) == rows_of(want.select(*ranked.columns))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranges = df.repartitionByRange("key", "at", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert ranges < 3000


def test_ranks_of_null_series_and_empty_frames(spark):
    df = spark.createDataFrame([(None, 1, 3.0), (None, 2, 5.0), ("a", 1, 1.0)], "key string, at int, value double")
    got = {(r["key"], r["at"]): r["rolling_mean"] for r in gr.rolling_mean(df, "value", ["key"], ["at"], 2).collect()}
    assert got == {(None, 1): None, (None, 2): 4.0, ("a", 1): None}
    assert gr.rolling_mean(df.limit(0), "value", ["key"], ["at"], 2).count() == 0
