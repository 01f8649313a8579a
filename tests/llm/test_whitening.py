"""Whitening against the eigenvectors of the covariance."""

import numpy as np
import pytest

from platewise.llm import queries
from platewise.llm import whitening as W

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, n long, component string, x int"


def plain(vectors, k=32):
    """(n, deviations, whitened, explained) of the vectors, as the operator defines them."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = ((n * x - s).astype(float)) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, int((e > e[0] * 1e-12).sum()))
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(df, rows, tolerance=1e-8):
    """``rows``: the (vec_id, vector) that stay, ids distinct."""
    n, deviations, white, explained = plain([v for _, v in rows])
    got = df.toPandas()
    assert set(got["n"]) == {n} and len(got) == n * white.shape[1]
    assert (got["identity_error"] < 1e-9).all() and got["identity_error"].nunique() == 1
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table * signs - white).max() < tolerance
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    first = got.drop_duplicates("vec_id").set_index("vec_id")["deviation"]
    assert [int(first[i]) for i, _ in rows] == [int(d) for d in deviations]


def test_embeddings_match_the_eigenvectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op11_whitening(spark, SF), rows)


def test_dropped_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.standard_normal(6) * [9, 5, 3, 2, 1, 1] + 4], i, "c", 7) for i in range(50)]
    odd = [(90, None), (91, [1.0, None, *[1.0] * 4]), (92, [1.0, float("nan"), *[1.0] * 4]),
           (93, [1.0, float("inf"), *[1.0] * 4]), (94, [1.0]), (95, [])]
    df = spark.createDataFrame(rows + [(i, v, None, None, None) for i, v in odd], SCHEMA).repartition(5)
    check(W.whiten(df), [r[:2] for r in rows])


def test_null_and_repeated_ids_are_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 2.0]), (None, [3.0, 1.0]), (None, [3.0, 1.0])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1"] * 4 + ["None"] * 4 and {r["n"] for r in got} == {4}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]])
def test_no_component_no_row(spark, rows):
    df = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert df.count() == 0 and df.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_vectors_than_dimensions_and_constant_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(8)] + [2.5]) for i in range(5)]
    check(W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), rows)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(np.float32(1e9 * (i % 3))), float(i)]) for i in range(9)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    _, deviations, _, _ = plain([v for _, v in rows])
    assert {r["vec_id"]: int(r["deviation"]) for r in got.collect()} == dict(enumerate(map(int, deviations)))


def test_equal_singular_values_are_all_found():
    x = np.vstack([np.eye(5)] * 2) * 3.0
    x = x - x.mean(axis=0)
    v, b = W.bidiagonalise(lambda w: x.T @ (x @ w), 5)
    assert np.allclose(v @ v.T, np.eye(5)) and np.allclose(np.tril(b, -1), 0) and np.allclose(np.triu(b, 2), 0)
    assert np.allclose(np.linalg.svd(b)[1], np.linalg.svd(x)[1])


def test_bidiagonal_factors_reproduce_the_products():
    x = np.random.default_rng(1).standard_normal((200, 12)) * np.logspace(0, -3, 12)
    v, b = W.bidiagonalise(lambda w: x.T @ (x @ w), 12)
    u = x @ v.T @ np.linalg.inv(b)
    assert np.allclose(u.T @ u, np.eye(12), atol=1e-8) and np.allclose(u @ b, x @ v.T)
