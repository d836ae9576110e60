"""Jacobi-Davidson and whitening against a dense eigensolver."""

import numpy as np
import pytest

from ragspark.llm import whitening as wh


@pytest.mark.parametrize("dim, wanted", [(1, 1), (3, 8), (40, 8), (300, 8)])
def test_pairs_are_those_of_a_dense_solver(dim, wanted):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    truth = np.sort(rng.uniform(0.1, 1, dim) * np.where(np.arange(dim) < 12, 40, 1))[::-1]
    a, seen = (q * truth) @ q.T, []
    a = (a + a.T) / 2
    values, vectors = wh.leading_eigenpairs(lambda w: (seen.append(w.shape[1]), a @ w)[1], dim, wanted)
    k = min(dim, wanted)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=1e-13, atol=0)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * values[0] and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-13)
    if dim == 300:
        assert sum(seen) < 40 * wanted  # products of one vector; a dense matrix takes 300


def test_equal_and_zero_eigenvalues():
    a = np.diag([5.0, 5.0, 5.0, 1.0, 0.0, 0.0])
    values, vectors = wh.leading_eigenpairs(lambda w: a @ w, 6, 6)
    assert np.allclose(values, [5, 5, 5, 1, 0, 0], atol=1e-14) and np.allclose(vectors.T @ vectors, np.eye(6))


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    b = rng.standard_normal((20, 3))
    assert np.allclose(a @ wh.minres(lambda v: a @ v, b, 60, 1e-12), b, atol=1e-8)
    assert (wh.minres(lambda v: a @ v, np.zeros((20, 2)), 5) == 0).all()


def _vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>{extra}")


def test_whitened_rows_against_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((400, 12)) * np.linspace(2, 0.3, 12)).astype(np.float32)
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0]), (906, [1e30] * 12)]
    df = _vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)] + bad).repartition(5)
    got = wh.whitened(df).toPandas()
    assert len(got) == 400 * 8 and set(got["component"]) == set(range(1, 9)) and (got["n"] == 400).all()
    whole = np.floor(1024 * x.astype(float)).astype(np.int64) + 100_000
    total = whole.sum(0)
    y = whole - total / 400
    e, u = np.linalg.eigh(y.T @ y / 400)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    want, have = y @ u / np.sqrt(e), got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(have * np.sign((have * want).sum(0)) - want).max() < 1e-10
    assert got.groupby("vec_id")["deviation"].first().tolist() == ((400 * whole - total) ** 2).sum(1).tolist()
    assert np.allclose(got.groupby("component")["explained"].first(), e / np.trace(y.T @ y / 400), rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-12


def test_deviation_is_exact_beyond_a_long(spark):
    df = _vectors(spark, [(1, [3e9, 1.0]), (2, [-3e9, 0.5]), (3, [0.0, 0.0])])
    x = [[int(1024 * c) + 100_000 for c in v] for v in ([float(np.float32(3e9)), 1.0], [-float(np.float32(3e9)), 0.5], [0.0, 0.0])]
    s = [sum(c) for c in zip(*x)]
    got = {r["vec_id"]: int(r["deviation"]) for r in wh.whitened(df).collect()}
    assert got == {i + 1: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(x)}


def test_empty_equal_repeated_and_degenerate_rows(spark):
    none = _vectors(spark, []).where("vec_id < 0")
    assert wh.whitened(none).count() == 0 and wh.whitened(_vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    flat = _vectors(spark, [(i % 5, [float(i % 5), 2.0 * (i % 5), 1.0], "v", 3) for i in range(20)] + [(None, [9.0, 18.0, 1.0], None, None)], ", x string, block int")
    got = wh.whitened(flat).collect()
    assert len(got) == 21 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
