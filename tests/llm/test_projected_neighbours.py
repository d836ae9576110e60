"""Projected neighbours against brute force, at production parameters and with many small blocks."""

import os

import numpy as np
import pytest

from ragspark.llm import projected_neighbours as pn

SF = "/root/testdata/sf0.01"


def _frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"id long, vector array<float>{extra}")


def _found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def _exact(ids, x, qi, q, k):
    score = x @ q
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != qi][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_quantile_inverts_the_chi_square_distribution():
    draws = (np.random.default_rng(0).standard_normal((200_000, 8)) ** 2).sum(1)
    for p in (0.5, 0.9, 0.99):
        assert abs((draws <= pn.chi_square_quantile(p, 8)).mean() - p) < 0.005


@pytest.mark.parametrize("block_rows", [pn.BLOCK_ROWS, 64])
def test_recall_of_inner_products(spark, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 16))) * rng.uniform(0.5, 2, (1500, 1))
    x = x.astype(np.float32).astype(float)
    ids = np.arange(1500)
    vectors = _frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)])
    got = _found(pn.neighbours(vectors.where("id % 20 = 0"), vectors, 20, block_rows=block_rows))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for qi, rows in got.items():
        want = _exact(ids, x, qi, x[qi], 20)
        assert [r[0] for r in rows] == list(range(1, 21)) and qi not in {r[1] for r in rows}
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        assert all(abs(s - x[v] @ x[qi]) < 1e-9 for _, v, s in rows)
        hits += len({v for v, _ in want} & {r[1] for r in rows})
    assert hits / (20 * len(got)) >= 0.95


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_recall_of_the_query(spark):
    from ragspark.llm import queries

    got = _found(queries.op11_projected_neighbours(spark, SF))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = [len({v for v, _ in _exact(ids, x, i, q, 20)} & {r[1] for r in got[i]}) for i, q in zip(ids.tolist(), x) if i % 20 == 0]
    assert sum(hits) / (20 * len(hits)) >= 0.95


def test_the_search_stops_before_all_is_verified():
    """Leaves beyond the stopping radius are never met: their rows may hold anything."""
    rng = np.random.default_rng(5)
    near, far = rng.standard_normal((300, 8)) * 0.05, rng.standard_normal((3000, 8)) * 0.05 + 40
    x = np.concatenate([near, far])
    p = pn.projected(x, None, 8)
    poisoned = x.copy()
    poisoned[300:] = np.nan
    with np.errstate(invalid="raise"):
        best, rows = pn.search_block(near[:5], p[:5], np.full(5, np.inf), poisoned, p, float((x**2).sum(1).max()), 3, pn.chi_square_quantile(0.99, 8))
    assert (rows >= 0).all() and (rows < 300).all() and np.isfinite(best).all()


def test_copies_ties_and_rows_that_take_no_part(spark):
    same = [3.0, 4.0]
    rows = [(i, same) for i in range(100, 160)] + [(7, same), (7, same), (1, [1.0, 0.0]), (2, [-0.0, 2.0])]
    bad = [(300, None), (301, []), (302, [0.0, 0.0]), (303, [float("nan"), 1.0]), (304, [float("inf"), 1.0]), (305, [None, 1.0]), (306, [1.0, 2.0, 3.0]), (None, same)]
    vectors = _frame(spark, rows + bad)
    got = _found(pn.neighbours(vectors.where("id in (7, 1, 101, 300, 303, 306)"), vectors, 5))
    assert sorted(got) == [1, 7, 101]
    assert [(v, s) for _, v, s in got[7]] == [(i, 25.0) for i in (100, 101, 102, 103, 104)]
    assert [v for _, v, _ in got[101]] == [7, 100, 102, 103, 104]
    assert [(v, s) for _, v, s in got[1]] == [(7, 3.0), (100, 3.0), (101, 3.0), (102, 3.0), (103, 3.0)]


def test_few_candidates_several_vectors_of_an_id_and_no_rows(spark):
    vectors = _frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [5.0, 0.0]), (3, [2.0, 0.0])])
    got = _found(pn.neighbours(vectors, vectors, 20))
    assert [(v, s) for _, v, s in got[1]] == [(2, 5.0), (3, 2.0)]
    assert [(v, s) for _, v, s in got[2]] == [(1, 0.0), (3, 0.0)]  # asks with its lesser vector
    none = vectors.where("id < 0")
    assert pn.neighbours(none, none, 3).count() == 0 and pn.neighbours(none, vectors, 3).count() == 0 and pn.neighbours(vectors, none, 3).count() == 0
    assert _found(pn.neighbours(vectors.where("id = 1"), vectors.where("id = 1"), 3)) == {}


def test_columns_with_clashing_names_change_nothing(spark):
    rows = [(i, [float(i), 1.0], 1, 2, "x") for i in range(1, 30)]
    vectors = _frame(spark, rows, ", cell int, bucket int, p string")
    assert _found(pn.neighbours(vectors.where("id = 3"), vectors, 2)) == {3: [(1, 29, 88.0), (2, 28, 85.0)]}
