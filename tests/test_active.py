"""Wide group lasso and the exact lasso path by their optimality conditions."""

import numpy as np
import pytest

from sparsetab.operators import active as A, fit as L

SCHEMA = "problem_id long, row_id long, x array<double>, y double"


def frame(spark, data):
    return spark.createDataFrame([(k, i, [float(v) for v in x[i]], float(y[i])) for k, (x, y) in data.items() for i in range(len(y))], SCHEMA).repartition(4)


def sample(seed, n, p):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + 0.5
    return x, x[:, :4] @ np.array([2.0, -1.5, 1.0, 0.7]) + 3.0 + 0.3 * rng.normal(size=n)


def worst(x, y, lam, members, fitted):
    """Largest breach of the optimality conditions, as a share of lambda."""
    latent = {g: np.zeros(x.shape[1]) for g in members}
    for e in fitted.entries:
        latent[e.group_id][e.col_id] = e.w
    w = sum(latent.values())
    gap = y - x @ w - fitted.c
    assert abs(gap.mean()) < 1e-8
    slope = 2 * (x - x.mean(0)).T @ gap / len(y)
    out = 0.0
    for g, at in members.items():
        size = np.linalg.norm(latent[g])
        out = max(out, np.abs(slope[at] - lam * latent[g][at] / size).max() / lam if size > 0 else np.linalg.norm(slope[at]) / lam - 1)
    return out


def test_wide_group_lasso(spark):
    """6000 columns in groups of five; no Gram matrix of them is made."""
    x, y = sample(1, 60, 6000)
    members = {g: list(range(5 * g, 5 * g + 5)) for g in range(1200)}
    groups = spark.createDataFrame([(g, c) for g, at in members.items() for c in at], "group_id int, col_id int")
    jobs = spark.createDataFrame([(0, 0, 1.5), (0, 1, 0.8)], "problem_id long, job_id int, lam double")
    for r in A.wide_group_lasso(frame(spark, {0: (x, y)}), jobs, groups, most=20).collect():
        assert r.converged and r.excess <= 1e-6 and len(r.entries) > 0
        assert worst(x, y, r.lam, members, r) < 1e-6


def test_overlapping_groups_agree_with_the_gram_form(spark):
    data = {k: sample(5 + k, 80, 50) for k in range(2)}
    members = {g: list(range(5 * g, min(50, 5 * g + 8))) for g in range(10)}
    groups = spark.createDataFrame([(g, c) for g, at in members.items() for c in at], "group_id int, col_id int")
    jobs = spark.createDataFrame([(k, j, lam) for k in data for j, lam in enumerate((1.0, 0.4, 1e9))], "problem_id long, job_id int, lam double")
    got = {(r.problem_id, r.job_id): r for r in A.wide_group_lasso(frame(spark, data), jobs, groups, most=2).collect()}
    assert len(got) == 6
    for (k, j), r in got.items():
        assert r.converged and worst(*data[k], r.lam, members, r) < 1e-6
        assert (len(r.entries) == 0) == (j == 2)


def test_exact_path(spark):
    data = {0: sample(3, 120, 64), 1: sample(4, 90, 64)}
    design = L.GramDesign.of(frame(spark, data), centre=True)
    paths = {}
    for r in A.lasso_breakpoints(design, 0.01).orderBy("problem_id", "step").collect():
        w = np.zeros(data[r.problem_id][0].shape[1])
        w[r.idx] = r.w
        paths.setdefault(r.problem_id, []).append((r.lam, w))
    for k, (x, y) in data.items():
        xc, yc = x - x.mean(0), y - y.mean()
        path = paths[k]
        assert len(path) > 10 and path[-1][0] == pytest.approx(0.01) and path[0][0] == pytest.approx(2 * np.abs(xc.T @ yc).max() / len(y))
        assert all(a[0] > b[0] for a, b in zip(path, path[1:]))
        for (la, wa), (lb, wb) in zip(path, path[1:]):
            for share in (0.0, 0.3, 1.0):  # at breakpoints and between them
                lam, w = la + share * (lb - la), wa + share * (wb - wa)
                slope = 2 * xc.T @ (yc - xc @ w) / len(y)
                assert np.abs(slope).max() <= lam * (1 + 1e-7)
                on = np.abs(w) > 1e-9
                np.testing.assert_allclose(slope[on], lam * np.sign(w[on]), rtol=1e-6)
