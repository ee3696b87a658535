"""Tiled Gram matrices and QR against NumPy, wide and badly conditioned ones among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsetab.operators import fit as L, matrix as M, tall as T


def frame(spark, parts, y=None):
    rows = [(k, i, [float(v) for v in row], float(y[k][i]) if y else 0.0) for k, x in parts.items() for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "problem_id long, row_id long, x array<double>, y double").repartition(5)


@pytest.mark.parametrize("tile, held", [(4, 50), (7, 1 << 20), (64, 1)])
def test_tiled_gram(spark, tile, held):
    rng = np.random.default_rng(1)
    parts = {0: rng.normal(size=(40, 19)), 1: rng.normal(size=(3, 19)), 2: rng.normal(size=(30, 4))}
    got = {(r.problem_id, r.i): list(r.sums) for r in T.tiled_gram(frame(spark, parts), ["problem_id"], tile=tile, held=held).collect()}
    assert len(got) == 19 + 19 + 4
    for k, x in parts.items():
        for i, row in enumerate(x.T @ x):
            np.testing.assert_allclose(got[k, i], row, atol=1e-9)
    assert T.tiled_gram(frame(spark, parts).limit(0), ["problem_id"]).count() == 0


def test_wide_gram(spark):
    """More columns than a plain Gram matrix takes; ``gram`` takes the tiles by itself."""
    rng = np.random.default_rng(2)
    p, x = 5600, rng.normal(size=(12, 5600))
    rows = frame(spark, {0: x})
    got = M.gram(rows, ["problem_id"]).filter("i % 700 = 3").collect()
    assert len(got) == 8
    for r in got:
        np.testing.assert_allclose(np.array(r.sums), x[:, r.i] @ x, atol=1e-8)


def test_least_squares_of_a_bad_condition(spark):
    """Columns that differ in the tenth digit; the normal equations lose them."""
    rng = np.random.default_rng(3)
    u, v = np.linalg.qr(rng.normal(size=(300, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = u @ np.diag(np.logspace(0, -10, 6)) @ v.T
    truth = rng.normal(size=6)
    twins = np.hstack([rng.normal(size=(50, 3)), np.ones((50, 1)), np.ones((50, 1))])
    y = {0: x @ truth, 1: twins @ np.array([1.0, 2.0, 3.0, 4.0, 0.0]) + rng.normal(size=50), 2: np.array([1.0])}
    parts = {0: x, 1: twins, 2: np.array([[1.0, 2.0]])}
    got = {r.problem_id: r for r in T.least_squares(frame(spark, parts, y), ["problem_id"]).collect()}
    np.testing.assert_allclose(got[0].w, truth, atol=1e-4)
    residual = x @ np.array(got[0].w) - y[0]
    assert got[0]["rank"] == 6 and np.abs(residual).max() < 1e-12 and got[0].rss < 1e-20
    want = np.linalg.lstsq(twins, y[1], rcond=None)
    assert got[1]["rank"] == 4 and got[1].rss == pytest.approx(((twins @ want[0] - y[1]) ** 2).sum())
    np.testing.assert_allclose(got[1].w, want[0], atol=1e-9)
    np.testing.assert_allclose(got[2].w, [0.2, 0.4], atol=1e-12)


def test_singular_values_and_trace_norms(spark):
    rng = np.random.default_rng(4)
    parts = {0: rng.normal(size=(500, 7)), 1: rng.normal(size=(3, 7))}
    got = {r.problem_id: r["values"] for r in T.singular_values(frame(spark, parts), ["problem_id"]).collect()}
    for k, x in parts.items():
        np.testing.assert_allclose(got[k], np.linalg.svd(x, compute_uv=False), atol=1e-9)
    groups = spark.createDataFrame([(g, c) for g in range(3) for c in range(7) if c % 3 <= g], "group_id int, col_id int")
    weights = {r.group_id: r.norm for r in T.trace_norms(frame(spark, {0: parts[0]}), groups).collect()}
    for g in range(3):
        assert weights[g] == pytest.approx(np.linalg.svd(parts[0][:, [c for c in range(7) if c % 3 <= g]], compute_uv=False).sum())
