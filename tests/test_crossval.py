"""Nested cross-validation and recovery sweeps against loops over folds and trials in NumPy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_fit import keep, numpy_niht

from sparsetab.operators import crossval as X

K, SUB = 3, 2


def sample(seed, n=90, p=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + 0.3
    y = np.where(x[:, 0] - 0.8 * x[:, 3] + 0.5 * rng.normal(size=n) > 0, 1.0, -1.0)
    return x, y, rng.integers(0, K, n), rng.integers(0, SUB, n)


DATA = {0: sample(1), 1: sample(2)}
SIZES = [1, 2, 4]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, i, [float(v) for v in x[i]], float(y[i]), int(f[i]), int(j[i])) for k, (x, y, f, j) in DATA.items() for i in range(len(y))]
    return spark.createDataFrame(data, "problem_id long, row_id long, x array<double>, y double, fold int, subfold int").repartition(4)


def fitted(x, y, s):
    mx, my = x.mean(0), y.mean()
    w = numpy_niht(x - mx, y - my, s, 30)
    return w, my - mx @ w


def balanced_error(y, score):
    label = np.where(score > 0, 1, -1)
    return ((label != y) & (y > 0)).sum() / max(1, (y > 0).sum()) / 2 + ((label != y) & (y < 0)).sum() / max(1, (y < 0).sum()) / 2


def area(y, score):
    up, down = score[y > 0], score[y < 0]
    return ((up[:, None] > down[None, :]).mean() + (up[:, None] == down[None, :]).mean() / 2)


def test_training_sums_are_those_of_the_rows(rows):
    got = {(r.problem_id, r.fold, r.subfold, r.i): list(r.sums) for r in X.training_sums(rows, K, SUB).collect()}
    assert len(got) == 2 * K * (SUB + 1) * 10
    for k, (x, y, f, j) in DATA.items():
        wide = np.hstack([x, y[:, None], np.ones((len(y), 1))])
        for fold in range(K):
            for sub in range(-1, SUB):
                at = (f != fold) & (j != sub)
                want = wide[at].T @ wide[at]
                for i in range(10):
                    np.testing.assert_allclose(got[k, fold, sub, i], want[i], atol=1e-9)


def test_nested_cv_equals_a_loop_over_folds(spark, rows):
    grid = spark.createDataFrame([(i, s) for i, s in enumerate(SIZES)], "job_id int, s int")
    got = {(r.problem_id, r.fold): r for r in X.nested_cv_fit(rows, grid, SIZES, K, SUB, max_epochs=30, tol=0.0).collect()}
    assert len(got) == 2 * K
    for k, (x, y, f, j) in DATA.items():
        for fold in range(K):
            train = f != fold
            errors = []
            for s in SIZES:
                total = 0.0
                for sub in range(SUB):
                    w, c = fitted(x[train & (j != sub)], y[train & (j != sub)], s)
                    total += balanced_error(y[train & (j == sub)], x[train & (j == sub)] @ w + c)
                errors.append(round(total, 12))
            best = int(np.argmin(errors))
            w, c = fitted(x[train], y[train], SIZES[best])
            r, score = got[k, fold], x[~train] @ w + c
            assert (r.job_id, r.s, r.n) == (best, SIZES[best], (~train).sum()) and r.sub_bacc == pytest.approx(errors[best], abs=1e-9)
            assert r.bacc == pytest.approx(balanced_error(y[~train], score), abs=1e-9) and r.auc == pytest.approx(area(y[~train], score), abs=1e-9)
            assert r.acc == pytest.approx((np.where(score > 0, 1, -1) == y[~train]).mean(), abs=1e-9)


def draw(seed, *keys):
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:13], 16)


def test_recovery_sweep(spark):
    """Errors of every trial, size and method against the same draws in NumPy; more rows never recover less often here."""
    rng = np.random.default_rng(4)
    n, p, s, sizes = 80, 12, 2, [6, 20, 60]
    x = rng.normal(size=(n, p)) / np.sqrt(20)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "row_id long, x array<double>")
    trials = spark.createDataFrame([(t,) for t in range(6)], "trial int")
    errors, prob, least = X.recovery_sweep(rows, trials, sizes, s, ["niht", "cosamp"], tol=1e-4, seed=3)
    got = {(r.trial, r.n, r.method): r.err for r in errors.collect()}
    assert len(got) == 6 * 3 * 2
    for t in range(6):
        order = sorted(range(n), key=lambda i: (draw(3, t, i), i))
        on = sorted(range(p), key=lambda j: draw(4, t, j))[:s]
        truth = np.zeros(p)
        truth[on] = 1.0
        for size in sizes:
            at = order[:size]
            w = numpy_niht(x[at], x[at] @ truth, s, 500)
            assert got[t, size, "niht"] == pytest.approx(np.linalg.norm(w - truth), abs=1e-5), (t, size)
    share = {(r.method, r.n): r.prob for r in prob.collect()}
    assert share["cosamp", 60] == share["niht", 60] == 1.0 and share["niht", 6] < 1.0
    assert {r.method for r in least.collect()} == {"niht", "cosamp"}
