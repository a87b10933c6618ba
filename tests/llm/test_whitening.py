"""Whitening against plain linear algebra."""

import numpy as np
import pytest

from clinspark.llm import queries, whitening
from clinspark.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, whitened string, N int"


def matrices():
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    return {
        "one": np.array([[3.0]]), "random": (lambda x: x @ x.T)(rng.normal(size=(20, 30))), "low rank": (lambda x: x @ x.T)(rng.normal(size=(20, 4))),
        "repeated": q @ np.diag([5.0] * 4 + [2.0] * 4 + [1.0] * 4) @ q.T, "identity": np.eye(9), "near": q @ np.diag(3 + np.arange(12) * 1e-13) @ q.T,
        "scales": np.diag(10.0 ** np.arange(-8, 4)), "diagonal blocks": np.kron(np.diag([2.0, 3.0]), np.ones((5, 5))), "zeros": np.zeros((6, 6)),
        "negative": -np.eye(4) + 0.1,
    }


@pytest.mark.parametrize("name", list(matrices()))
def test_eigenpairs(name):
    a = (matrices()[name] + matrices()[name].T) / 2
    values, vectors = whitening.leading_eigenpairs(a, 8)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    size = max(1e-300, np.abs(a).max())
    assert np.abs(values - want).max() <= 1e-13 * size * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size * len(a)


def test_inertia():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 8, 25):
        for _ in range(20):
            a = rng.normal(size=(n, n))
            a = a + a.T
            if rng.random() < 0.3:
                np.fill_diagonal(a, 0.0)  # needs pivots of two rows
            assert whitening.negative_count(a) == (np.linalg.eigvalsh(a) < 0).sum()


def plain(x):
    x = np.floor(64 * np.asarray(x, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    return ((n * x - s) ** 2).sum(axis=1), e[::-1][:32], q[:, ::-1][:, :32], centred, np.trace(v)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = sorted(table(spark, d, "embeddings").collect(), key=lambda r: r["vec_id"])
    deviation, e, q, centred, trace = plain([r["embedding"] for r in rows])
    got = queries.op13_whitening(spark, d).orderBy("vec_id", "component").collect()
    assert [(r["vec_id"], r["component"]) for r in got] == [(r["vec_id"], c) for r in rows for c in range(1, 33)]
    assert [r["deviation"] for r in got[::32]] == deviation.tolist() and {r["n"] for r in got} == {len(rows)}
    made = np.array([r["whitened"] for r in got]).reshape(-1, 32)
    want = centred @ q / np.sqrt(e)
    assert np.abs(made * np.sign((made * want).sum(axis=0)) - want).max() < 1e-8
    assert np.allclose([r["explained"] for r in got[:32]], e / trace, rtol=1e-10, atol=0)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    assert np.abs(made.T @ made / len(made) - np.eye(32)).max() < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(30, 3)).tolist()
    bad = [None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("-inf"), 0.0, 0.0], [1.0], []]
    rows = [(k if k else None, v, "w", 1) for k, v in enumerate(good)] + [(99, v, None, None) for v in bad] + [(1, good[1], "w", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = whitening.fit(df)
    made = whitening.whiten(df, model).collect()
    deviation, e, q, centred, _ = plain([*good, good[1]])
    assert model.n == 31 and len(made) == 31 and sum(r["vec_id"] is None for r in made) == 1
    assert sorted(r["deviation"] for r in made) == sorted(deviation.tolist())
    assert np.allclose(model.values, e, rtol=1e-12) and model.identity_error < 1e-9


def test_flat_and_huge(spark):
    flat = spark.createDataFrame([(k, [2.0, float(k), 2.0 * k], "", 0) for k in range(8)], SCHEMA)
    model = whitening.fit(flat)
    assert model.full.tolist() == [True, False, False] and model.identity_error < 1e-9
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in whitening.whiten(flat, model).collect())
    same = spark.createDataFrame([(k, [1.0, 1.0], "", 0) for k in range(3)], SCHEMA)
    model = whitening.fit(same)
    assert [(r["deviation"], r["whitened"]) for r in whitening.whiten(same, model).collect()] == [(0, [None, None])] * 3
    huge = spark.createDataFrame([(1, [1e30, 0.0], "", 0), (2, [-1e30, 1.0], "", 0), (3, [0.0, -1.0], "", 0)], SCHEMA)
    model = whitening.fit(huge)
    made = whitening.whiten(huge, model).collect()
    assert [r["deviation"] for r in made if r["vec_id"] < 3] == [None, None] and np.isfinite(model.values).all()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = whitening.fit(none)
    assert model.n == 0 and whitening.whiten(none, model).count() == 0
    empty = spark.createDataFrame([(1, [], "", 0), (2, None, "", 0)], SCHEMA)
    assert whitening.whiten(empty, whitening.fit(empty)).count() == 0
