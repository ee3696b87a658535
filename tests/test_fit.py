"""Fits against direct NumPy loops on seeded data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsetab.operators import fit as L, matrix as M

SCHEMA = "problem_id long, row_id long, x array<double>, y double"
N, P, S = 60, 12, 3


def sample(seed, classes=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(N, P)) / np.sqrt(N)
    w = np.zeros(P)
    w[rng.choice(P, S, replace=False)] = rng.normal(size=S) + 2.0
    y = x @ w
    return x, (np.where(y + 0.05 * rng.normal(size=N) > 0.05, 1.0, -1.0) if classes else y), w


DATA = {k: sample(k) for k in range(3)}
CLASSES = sample(7, classes=True)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, i, [float(v) for v in x[i]], float(y[i])) for k, (x, y, _) in DATA.items() for i in range(N)], SCHEMA)


@pytest.fixture(scope="module")
def class_rows(spark):
    x, y, _ = CLASSES
    return spark.createDataFrame([(0, i, [float(v) for v in x[i]], float(y[i])) for i in range(N)], SCHEMA)


def jobs(rows, **params):
    out = rows.select("problem_id").distinct().withColumn("job_id", F.lit(0))
    for name, value in params.items():
        out = out.withColumn(name, F.lit(value))
    return out


def vectors(fitted):
    found = {}
    for r in fitted.collect():
        w = np.zeros(P)
        w[list(r.idx)] = list(r.w)
        found[r.problem_id] = w
    return found


def keep(v, s):
    out = np.zeros_like(v)
    top = sorted(range(len(v)), key=lambda i: (-abs(v[i]), i))[:s]
    out[top] = v[top]
    return out


@pytest.mark.parametrize("kind", ["gram", "rows"])
def test_iht(rows, kind):
    design = L.GramDesign.of(rows) if kind == "gram" else L.RowDesign.of(rows)
    got = vectors(L.iht(design, jobs(rows, lr=0.5), S, 4, tol=0.0))
    for k, (x, y, _) in DATA.items():
        w = np.zeros(P)
        for _ in range(4):
            w = keep(w - 0.5 * x.T @ (x @ w - y), S)
        np.testing.assert_allclose(got[k], w, atol=1e-9)


def test_stochastic_iht_uses_drawn_blocks(spark, rows):
    design = L.GramDesign.of(rows, b=25)  # two blocks, ten rows left over
    got = vectors(L.iht(design, jobs(rows, lr=0.4), S, 2, tol=0.0, stochastic=True, seed=3))
    steps = spark.createDataFrame([(k, 0, e, t) for k in DATA for e in range(2) for t in range(2)], "problem_id long, job_id int, e int, t int")
    drawn = {(r.problem_id, r.e, r.t): r.b for r in steps.withColumn("b", M.chosen_block(3, F.col("e"), F.col("t"), F.lit(2), "problem_id", "job_id")).collect()}
    for k, (x, y, _) in DATA.items():
        w = np.zeros(P)
        for e in range(2):
            for t in range(2):
                at = slice(25 * drawn[k, e, t], 25 * (drawn[k, e, t] + 1))
                w = keep(w - 0.4 * 2 * x[at].T @ (x[at] @ w - y[at]), S)
        np.testing.assert_allclose(got[k], w, atol=1e-9)


def numpy_niht(x, y, s, epochs):
    w, c = np.zeros(x.shape[1]), 0.01
    gamma = set(np.nonzero(keep(x.T @ y, s))[0])
    for _ in range(epochs):
        g = x.T @ (y - x @ w)
        on = sorted(gamma)
        image = x[:, on] @ g[on]
        mu = g[on] @ g[on] / (image @ image) if image @ image else 1.0
        new = keep(w + mu * g, s)
        if set(np.nonzero(new)[0]) == gamma:
            w = new
            continue

        def long_enough(v, m):
            d = v - w
            bend = np.linalg.norm(x @ d) ** 2
            return bend <= 0 or m <= (1 - c) * (d @ d) / bend

        if long_enough(new, mu):
            w = new
            continue
        while not long_enough(new, mu):
            mu /= 2
            new = keep(w + mu * g, s)
        w, gamma = new, set(np.nonzero(new)[0])
    return w


def test_niht(rows):
    got = vectors(L.niht(L.GramDesign.of(rows), jobs(rows), S, 3, tol=0.0))
    for k, (x, y, _) in DATA.items():
        np.testing.assert_allclose(got[k], numpy_niht(x, y, S, 3), atol=1e-8)


@pytest.mark.parametrize("kind", ["gram", "rows"])
def test_cosamp_recovers(rows, kind):
    design = L.GramDesign.of(rows) if kind == "gram" else L.RowDesign.of(rows)
    got = vectors(L.cosamp(design, jobs(rows), S, 3, tol=1e-6))
    for k, (_, _, w) in DATA.items():
        np.testing.assert_allclose(got[k], w, atol=1e-6)


def balanced(x, y, w, c, lam, cp, cn, q=None):
    share = np.where(y > 0, cp, cn)
    z = y * (x @ w + c)
    loss = (share * np.logaddexp(0, -z)).mean() + lam / 2 * w @ w
    slope = -share * y / (1 + np.exp(z))
    return loss, x.T @ slope / len(y) + lam * w, slope.mean()


def test_balanced_iht(class_rows):
    x, y, _ = CLASSES
    lam, cp, cn = 1e-3, (y < 0).mean(), (y > 0).mean()
    got = L.balanced_iht(class_rows, jobs(class_rows, lam=lam), S, 2).first()
    w, c = np.zeros(P), 0.0
    for _ in range(2):
        loss, g, gc = balanced(x, y, w, c, lam, cp, cn)
        step = 1.0
        for _ in range(20):
            if balanced(x, y, w - step * g, c - step * gc, lam, cp, cn)[0] <= loss - step / 2 * (g @ g + gc * gc):
                break
            step *= 0.8
        w, c = keep(w - step * g, S), c - step * gc
    have = np.zeros(P)
    have[list(got.idx)] = list(got.w)
    np.testing.assert_allclose(have, w, atol=1e-9)
    assert got.c == pytest.approx(c, abs=1e-9)


@pytest.mark.parametrize("fit", ["iht", "stochastic", "niht", "cosamp", "balanced"])
def test_steps_in_a_task_and_by_jobs_agree(rows, class_rows, monkeypatch, fit):
    """Weights, epochs and the flag are those of the same fit taken step by step as jobs."""
    def run():
        if fit == "balanced":
            return L.balanced_iht(class_rows, jobs(class_rows, lam=1e-2), S, 3, num_blocks=2, seed=4, tol=0.05)
        if fit == "niht":
            return L.niht(L.GramDesign.of(rows), jobs(rows), S, 4, tol=1e-3)
        if fit == "cosamp":
            return L.cosamp(L.GramDesign.of(rows), jobs(rows), S, 3)
        if fit == "stochastic":
            return L.iht(L.GramDesign.of(rows, b=20), jobs(rows, lr=0.3), S, 3, stochastic=True, seed=2)
        return L.iht(L.GramDesign.of(rows), jobs(rows, lr=0.5), S, 6, tol=0.05)

    found = []
    for limit in (1 << 22, 1):
        monkeypatch.setattr(L.iterate, "LIMIT", limit)
        found.append(sorted(((r.problem_id, r.epochs, r.converged, r.idx, r.w) for r in run().collect()), key=lambda r: r[0]))
    for one, other in zip(*found):
        assert one[:4] == other[:4] and one[4] == pytest.approx(other[4], abs=1e-8)


def overlap(spark):
    return spark.createDataFrame([(i % 3, i) for i in range(P)] + [(3 + i % 4, i) for i in range(P)], "group_id int, col_id int")


def test_group_lasso_is_optimal(spark, rows):
    """Optimality of every latent group: gradient norm below lambda, equal to it where active."""
    lam = 0.02
    design = L.GramDesign.of(rows, centre=True)
    fitted = L.group_lasso(design, jobs(rows, lam=lam), overlap(spark), max_iter=120, tol=1e-10)
    members = {g: [i for i in range(P) if (g < 3 and i % 3 == g) or (g >= 3 and i % 4 == g - 3)] for g in range(7)}
    for r in fitted.collect():
        x, y, _ = DATA[r.problem_id]
        latent = {g: np.zeros(P) for g in members}
        for e in r.entries:
            latent[e.group_id][e.col_id] = e.w
        w = sum(latent.values())
        xc, yc = x - x.mean(0), y - y.mean()
        gradient = 2 * xc.T @ (xc @ w - yc) / N
        for g, at in members.items():
            size = np.linalg.norm(latent[g])
            if size > 1e-6:
                np.testing.assert_allclose(gradient[at], -lam * latent[g][at] / size, atol=2e-4)
            else:
                assert np.linalg.norm(gradient[at]) <= lam + 2e-4


def test_logistic_group_lasso_steps(spark, class_rows):
    x, y, _ = CLASSES
    lam, cp, cn, turns = 5e-3, (y < 0).mean(), (y > 0).mean(), 3
    members = {g: [i for i in range(P) if (g < 3 and i % 3 == g) or (g >= 3 and i % 4 == g - 3)] for g in range(7)}
    wide = np.hstack([x, np.ones((N, 1))])
    step = N / (0.25 * np.abs(wide.T @ wide).sum(1).max() * 2)
    latent, c = {g: np.zeros(P) for g in members}, 0.0
    for _ in range(turns):
        _, slope, slope_c = balanced(x, y, sum(latent.values()), c, 0.0, cp, cn)
        for g, at in members.items():
            moved = latent[g][at] - step * slope[at]
            latent[g][at] = moved * max(0.0, 1 - step * lam / np.linalg.norm(moved))
        c -= step * slope_c
    fitted = L.logistic_group_lasso(class_rows, jobs(class_rows, lam=lam), overlap(spark), balanced=True, max_iter=turns).first()
    have = {g: np.zeros(P) for g in members}
    for e in fitted.entries:
        have[e.group_id][e.col_id] = e.w
    for g in members:
        np.testing.assert_allclose(have[g], latent[g], atol=1e-9)
    assert fitted.c == pytest.approx(c, abs=1e-9)


def test_active_set_agrees_with_all_groups(spark, rows):
    one = rows.filter("problem_id = 0")
    design = L.GramDesign.of(one, centre=True)
    singles = spark.createDataFrame([(i, i) for i in range(P)], "group_id int, col_id int")
    point = jobs(one, lam=0.04)
    whole = {r.col_id: r.w for r in L.group_weights(L.group_lasso(design, point, singles, max_iter=60)).collect()}
    active = {r.col_id: r.w for r in L.group_weights(L.active_set_lasso(design, point, singles, max_iter=60)).collect()}
    assert whole and set(whole) == set(active)
    for col, w in whole.items():
        assert active[col] == pytest.approx(w, abs=1e-5)


def test_gradients_and_refit(spark, rows):
    design = L.GramDesign.of(rows)
    chosen = rows.select("problem_id").distinct().select("problem_id", F.lit(0).alias("job_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("group_id"))
    got = {(r.problem_id, r.col_id): r.w for r in L.refit(design, chosen, overlap(spark)).collect()}
    at = [i for i in range(P) if i % 3 in (0, 1)]
    for k, (x, y, _) in DATA.items():
        np.testing.assert_allclose([got[k, i] for i in at], np.linalg.lstsq(x[:, at], y, rcond=None)[0], atol=1e-8)


def test_screening(spark):
    norms = spark.createDataFrame([(0, 0, 0.5, g, v) for g, v in enumerate([0.52, 0.7, 0.1, 0.6, 0.45])], "problem_id long, job_id int, lam double, group_id int, norm double")
    active = spark.createDataFrame([(0, 0, 0)], "problem_id long, job_id int, group_id int")
    assert [r.group_id for r in L.screen_groups(norms, active, 1).collect()] == [1]
    assert {r.group_id for r in L.possibly_active(norms, active).collect()} == {0, 1, 3}


def test_trace_norms(spark, rows):
    one = rows.filter("problem_id = 0")
    groups = overlap(spark)
    got = {r.group_id: r.norm for r in M.trace_norms(M.gram(one, ["problem_id"]), groups).collect()}
    x = DATA[0][0]
    for g in range(7):
        at = [i for i in range(P) if (g < 3 and i % 3 == g) or (g >= 3 and i % 4 == g - 3)]
        assert got[g] == pytest.approx(np.linalg.svd(x[:, at], compute_uv=False).sum())


def test_sums_survive_many_keys_and_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(500).select((F.col("id") % 41).alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), F.col("id").alias("i"))
        got = {r.k: list(r.sums) for r in M.vector_sums(rows.repartition(5), ["k"], "x", F.lit(2.0)).collect()}
        assert len(got) == 41
        for k in range(41):
            ids = [i for i in range(500) if i % 41 == k]
            assert got[k] == [2.0 * sum(ids), 2.0 * len(ids)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wide_gram_is_refused(rows):
    with pytest.raises(ValueError):
        M.gram(rows, ["problem_id"], columns=M.MAX_GRAM_COLUMNS + 1)


def test_graph_fits_tell_whether_bands_were_met(spark):
    """On a path without costs no lambda leaves 3 of 10 columns."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(30, 10)), rng.normal(size=30)
    rows = spark.createDataFrame([(0, i, [float(v) for v in x[i]], float(y[i])) for i in range(30)], SCHEMA)
    free = spark.createDataFrame([(0, i, i + 1, 0.0) for i in range(9)], "problem_id long, src long, dst long, cost double")
    got = L.cosamp(L.GramDesign.of(rows), jobs(rows), 3, 1, graph=L.Graph(free)).collect()
    assert [r.in_band for r in got] == [False]
    assert "in_band" not in L.cosamp(L.GramDesign.of(rows), jobs(rows), 3, 1).columns


@pytest.mark.parametrize("graph", [False, True])
@pytest.mark.parametrize("steps", [2, 8])
def test_drawn_blocks_pass_through_a_task(spark, rows, monkeypatch, graph, steps):
    """Blocks that fit a task one by one, but not together, give the weights of those that fit together."""
    edges = spark.createDataFrame([(k, i, i + 1, 1.0) for k in DATA for i in range(P - 1)], "problem_id long, src long, dst long, cost double")
    monkeypatch.setattr(L.iterate, "STEPS", steps)
    found = []
    for limit in (1 << 22, 2 * P * P):
        monkeypatch.setattr(L.iterate, "LIMIT", limit)
        taken = []
        monkeypatch.setattr(L, "_run", lambda *a: taken.append(a))
        got = L.iht(L.GramDesign.of(rows, b=15), jobs(rows, lr=0.3), S, 5, tol=0.05, stochastic=True, seed=2, graph=L.Graph(edges) if graph else None)
        flags = ["in_band"] if graph else []
        found.append(sorted((tuple(r[c] for c in ("problem_id", "epochs", "done", "converged", "idx", *flags)), r.w, r.rss) for r in got.collect()))
        assert not taken  # no step is a job of its own
    for one, other in zip(*found, strict=True):
        assert one[0] == other[0] and one[1] == pytest.approx(other[1], abs=1e-9) and one[2] == pytest.approx(other[2], abs=1e-9)


@pytest.mark.parametrize("blocks", [1, 2])
def test_balanced_rows_beyond_a_gram_matrix_stay_in_a_task(class_rows, monkeypatch, blocks):
    """Rows of several times ``LIMIT`` numbers are fitted in a task, job by job, with the weights of smaller ones."""
    both = class_rows.select("problem_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("job_id")).distinct().withColumn("lam", 0.01 * (F.col("job_id") + 1))
    found = []
    for limit in (1 << 22, N * P // 4):
        monkeypatch.setattr(L.iterate, "LIMIT", limit)
        monkeypatch.setattr(L, "_replace", lambda *a: pytest.fail("a step as a job"))
        got = L.balanced_iht(class_rows, both, S, 6, num_blocks=blocks, seed=4)
        found.append(sorted((r.job_id, r.epochs, r.converged, r.idx, r.w, r.c) for r in got.collect()))
    assert len(found[0]) == 2 and found[0] == found[1]
