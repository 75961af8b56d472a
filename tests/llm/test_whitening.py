"""Whitening against numpy's symmetric eigensolver, and its rules for odd tables."""

import math
import random

import numpy as np
import pytest

from waymark.llm.whitening import eigen, one_sided_jacobi, pivoted_cholesky, whiten

SCHEMA = "vec_id long, embedding array<double>, dim int, n string, v binary"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "n", b"v") for i, e in rows], SCHEMA)


def expected(vectors, scale, components):
    x = np.array([[math.floor(scale * c) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, vec = np.linalg.eigh(c.T @ c / n)
    e, vec = e[::-1], vec[:, ::-1]
    deviation = ((n * x - s) ** 2).sum(axis=1)
    return n, deviation, (x - s / n) @ vec[:, :components] / np.sqrt(e[:components]), e / e.sum()


def test_factor_and_rotation():
    rng = np.random.default_rng(1)
    for d, rank in [(1, 1), (5, 5), (8, 3), (7, 0), (33, 33)]:
        a = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank)
        matrix = a @ a.T
        factor, order = pivoted_cholesky(matrix)
        assert factor.shape == (d, rank)
        assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)])
        assert np.all(np.triu(factor, 1) == 0)
        u = one_sided_jacobi(factor)
        assert np.allclose(u.T @ u, np.diag((u * u).sum(axis=0)), atol=1e-13)
        e, vec = eigen(matrix)
        assert np.allclose(e, np.linalg.eigvalsh(matrix)[::-1][:rank], rtol=1e-9)
        assert np.allclose(vec.T @ vec, np.eye(rank)) and np.allclose(vec * e @ vec.T, matrix)


@pytest.mark.parametrize("size", [6, 17])
def test_equals_eigensolver(spark, size):
    rng = random.Random(size)
    vectors = [[rng.gauss(0, 1 + j) + 5 * j for j in range(size)] for _ in range(200)]
    rows = [*enumerate(vectors), (7, vectors[3]), (None, vectors[4]), *((1000 + i, vectors[0]) for i in range(300))]
    bad = [(2000, None), (2001, [math.nan] * size), (2002, [math.inf] + [0.0] * (size - 1)), (2003, [None] + [0.0] * (size - 1))]
    got = whiten(table(spark, rows + bad), components=4, scale=16.0).toPandas()
    n, deviation, white, share = expected([v for _, v in rows], 16.0, 4)
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-12
    signs = None
    for i, (key, _) in enumerate(rows):
        mine = got[got["vec_id"].isna()] if key is None else got[got["vec_id"] == key]
        for _, one in mine.groupby(mine["deviation"]):
            if one["deviation"].iloc[0] != deviation[i]:
                continue
            one = one.sort_values("component").head(4)
            assert one["component"].tolist() == [1, 2, 3, 4]
            values = one["whitened"].to_numpy()
            signs = np.sign(values * white[i]) if signs is None else signs
            assert np.allclose(values * signs, white[i], atol=1e-8)
            assert np.allclose(one["explained"], share[:4], rtol=1e-9)
    assert signs is not None


def test_odd_tables(spark):
    def rows(vectors, **options):
        return [tuple(r) for r in whiten(table(spark, list(enumerate(vectors))), scale=1.0, **options).collect()]

    assert rows([]) == [] and rows([[], []]) == [] and rows([[1.0, 2.0], [1.0, 2.0]]) == []
    line = rows([[0.0, 0.0], [2.0, 0.0], [4.0, 0.0], [2.5, 0.5]])
    assert sorted(r[0] for r in line) == [0, 1, 2, 3] and {r[1] for r in line} == {1} and {r[5] for r in line} == {1.0}
    assert sorted(abs(r[4]) for r in line) == pytest.approx([0, 0, 1.5**0.5, 1.5**0.5])
    apart = rows([[1.0], [2.0], [1.0, 5.0], [2.0, 9.0], [1.0, 2.0, 3.0]])
    assert sorted((r[0], r[2]) for r in apart) == [(0, 2), (1, 2), (2, 2), (3, 2)]
    huge = rows([[1e300, 1.0], [-1e300, 2.0], [5e18, 3.0]], components=1)
    assert len(huge) == 3 and all(r[3] is None and math.isfinite(r[4]) for r in huge)
