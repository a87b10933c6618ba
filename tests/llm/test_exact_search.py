"""Cover-tree search against plain sorting, on planted shapes and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinspark.llm import covertree

SCHEMA = "vec_id long, embedding array<float>, region int, Score string"


def plain(x, ids, asked, k):
    """(query, vec, score) of the k largest inner products, by sorting all of them."""
    found = []
    for i in asked:
        scores = [sum(a * b for a, b in zip(x[i], row)) for row in x.tolist()]
        order = sorted((j for j in range(len(x)) if ids[j] != ids[i]), key=lambda j: (-scores[j], ids[j]))[:k]
        found += [(int(ids[i]), int(ids[j]), scores[j]) for j in order]
    return sorted(found)


def shapes():
    rng = np.random.default_rng(5)
    clusters = rng.normal(0, 400, (12, 6))[rng.integers(0, 12, 400)] + rng.normal(0, 5, (400, 6))
    return {
        "one": rng.integers(-9, 9, (1, 3)), "spread": rng.integers(-500, 500, (300, 16)), "clusters": np.round(clusters).astype(np.int64),
        "repeated": rng.integers(-3, 3, (250, 2)), "zeros": np.zeros((40, 4), np.int64), "huge": rng.integers(-(1 << 40), 1 << 40, (60, 3)),
    }


@pytest.mark.parametrize("name", list(shapes()))
def test_descend(name):
    x = shapes()[name]
    ids = np.random.default_rng(1).permutation(len(x)) * 2
    tree = covertree.cover_tree(x.astype(float))
    asked = np.arange(0, len(x), 3)
    got = covertree.descend(x[asked], ids[asked].tolist(), [None] * len(asked), x[tree.order], ids[tree.order], tree.parent, tree.radius, 7)
    limit = (1 << 63) - 1
    assert sorted(zip(*got[:3])) == sorted((q, v, max(-limit - 1, min(limit, s))) for q, v, s in plain(x.astype(object), ids, asked, 7))


@pytest.mark.parametrize("name", list(shapes()))
def test_tree_covers(name):
    x = shapes()[name].astype(float)
    tree = covertree.cover_tree(x)
    rows = x[tree.order]
    assert sorted(tree.order) == list(range(len(x)))
    for k in range(1, len(x)):
        assert tree.parent[k] < k
        up = tree.parent[k]
        while up >= 0:
            assert np.linalg.norm(rows[k] - rows[up]) <= tree.radius[up] * (1 + 1e-9)
            up = tree.parent[up]


def test_pruning():
    """Tight groups far from each other: most products are never made."""
    rng = np.random.default_rng(2)
    centres = np.concatenate([np.eye(10), -np.eye(10)]) * 5000
    x = np.round(centres[np.arange(2000) % 20] + rng.normal(0, 3, (2000, 10))).astype(np.int64)
    tree = covertree.cover_tree(x.astype(float))
    made = covertree.descend(x[:100], list(range(100)), [None] * 100, x[tree.order], tree.order, tree.parent, tree.radius, 5)[3]
    assert made < 0.2 * 100 * 2000


def test_search_of_several_trees(spark, monkeypatch):
    monkeypatch.setattr(covertree, "TREE_ROWS", 64)
    monkeypatch.setattr(covertree, "QUERY_ROWS", 16)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(0, 300, (9, 5))[rng.integers(0, 9, 500)] + rng.normal(0, 9, (500, 5))).astype(np.int64)
    x[100:300] = x[100]  # one vector is two fifths of all rows
    ids = np.arange(500) * 3
    rows = [(int(i), [v / covertree.SCALE for v in r], 1, "x") for i, r in zip(ids, x.tolist())]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double")).repartition(3)
    got = covertree.search(df, F.col("vec_id") % 5 == 0, 10).collect()
    want = plain(x, ids, [k for k in range(500) if ids[k] % 5 == 0], 10)
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == want
    for r in got:
        better = sum((s, -v) > (r["score"], -r["vec_id"]) for q, v, s in want if q == r["query_id"])
        assert r["rank"] == better + 1


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1, "a"), (0, [1.0, 0.5], 1, "a"), (1, [0.25, 0.25], 1, "b"), (2, None, 1, "c"), (3, [float("nan"), 1.0], 2, "d"),
        (4, [1.0, None], 2, "e"), (5, [float("inf"), 0.0], 2, "f"), (6, [0.0, 0.0], 2, "g"), (None, [1.0, 1.0], 2, "h"), (7, [2.0], 2, "i"),
        (8, [0.25, 0.25], None, None), (100, [], 3, "j"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in covertree.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    one, quarter = 1024 * 1024, 256 * 1024
    first = [(7, 2 * one), (1, quarter + 512 * 256), (8, quarter + 512 * 256), (6, 0), (100, 0)]
    assert got[:5] == [(0, n + 1, v, s) for n, (v, s) in enumerate(first)]
    assert got[5:] == [(100, n + 1, v, 0) for n, v in enumerate([0, 1, 6, 7, 8])]


def test_empty_and_alone(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert covertree.search(none, F.col("vec_id") % 2 == 0).count() == 0
    alone = spark.createDataFrame([(2, [1.0], 0, ""), (4, None, 0, "")], SCHEMA)
    assert covertree.search(alone, F.col("vec_id") % 2 == 0).count() == 0
    assert covertree.search(alone, F.lit(None).cast("boolean")).count() == 0
    empty = spark.createDataFrame([(2, [], 0, ""), (3, [], 0, "")], SCHEMA)
    assert [tuple(r) for r in covertree.search(empty, F.col("vec_id") == 2).collect()] == [(2, 1, 3, 0)]
