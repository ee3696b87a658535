"""Nested cross-validation and recovery sweeps, from raw rows to the report.

Rows are read once to sum the normal equations of every cell (outer fold, inner fold).  What a fit trains on is the whole
less the cells it leaves out, so training sums come by subtraction and no row is read again for them.  All fits of all
problems, folds and parameters are jobs of one run.  A second pass over the rows scores each with the models that did
not see it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sparsetab.functions.scalar import hashed, sparse_dot
from sparsetab.lineage import cut
from sparsetab.operators import fit as L
from sparsetab.operators.evaluate import auc, classification_rates
from sparsetab.operators.experiments import best_parameter, least_sample_size, recovery_probability
from sparsetab.operators.matrix import gram, vector_sums
from sparsetab.operators.ranking import ranked
from sparsetab.operators.relational import attach_row

P = "problem_id"
WHOLE = -1  # inner fold of a fit on the whole training side


def training_sums(rows: DataFrame, k: int, sub_k: int) -> DataFrame:
    """``X'X`` with response and ones as last columns, for every fit: ``(problem_id, fold, subfold, i, sums)``.

    ``rows(problem_id, row_id, x, y, fold, subfold)``: a row's outer fold, and the inner fold it is in whenever it
    trains.  Fit ``(f, j)`` leaves out fold ``f`` and inner fold ``j``; with ``j = -1`` it leaves out fold ``f`` alone.
    """
    wide = rows.select(P, "fold", "subfold", F.concat("x", F.array(F.col("y").cast("double"), F.lit(1.0))).alias("x"))
    cells = cut(gram(wide, [P, "fold", "subfold"]))
    outer, inner = F.explode(F.sequence(F.lit(0), F.lit(k - 1))), F.explode(F.sequence(F.lit(WHOLE), F.lit(sub_k - 1)))
    total = vector_sums(cells, [P, "i"], "sums").select(P, outer.alias("fold"), "i", "sums").withColumn("subfold", inner)
    left_out = F.concat(
        F.transform(F.sequence(F.lit(WHOLE), F.lit(sub_k - 1)), lambda j: F.struct(F.col("fold").cast("int").alias("f"), j.alias("j"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold")), lambda f: F.struct(f.alias("f"), F.col("subfold").cast("int").alias("j"))))
    removed = vector_sums(
        cells.select(P, "i", "sums", F.explode(left_out).alias("fit")).select(P, F.col("fit.f").alias("fold"), F.col("fit.j").alias("subfold"), "i", "sums"),
        [P, "fold", "subfold", "i"], "sums").withColumnRenamed("sums", "_out")
    return total.join(removed, [P, "fold", "subfold", "i"], "left").select(
        P, "fold", "subfold", "i", F.when(F.col("_out").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "_out", lambda a, b: a - b)).alias("sums"))


def _design(sums: DataFrame) -> tuple[L.GramDesign, DataFrame]:
    """Centred normal equations of every fit, and its means ``(problem_id, mx, my)``."""
    p = F.size("sums") - 2
    keyed = cut(sums.select(F.struct(P, "fold", "subfold").alias(P), "i", "sums"))
    last = keyed.filter(F.col("i") == p + 1).select(P, F.transform("sums", lambda v: v / F.element_at("sums", -1)).alias("_m"), F.element_at("sums", -1).alias("_n"))
    both = keyed.join(last, P).select(
        P, "i", "_n", "_m", F.when(F.col("i") <= p, F.zip_with("sums", "_m", lambda v, m: v - m * F.element_at("sums", -1))).otherwise(F.col("sums")).alias("sums"))
    table = both.filter(F.col("i") < p).select(P, F.lit(L.FULL).alias("block"), "i", F.slice("sums", 1, p).alias("g"), F.get("sums", p).alias("xty"))
    stats = both.groupBy(P).agg(F.max(F.when(F.col("i") == p, F.get("sums", p))).alias("yy"), F.max("_n").alias("n"), F.lit(1).alias("num_blocks"), F.max(p).alias("p"))
    means = last.select(P, F.slice("_m", 1, F.size("_m") - 2).alias("mx"), F.get("_m", F.size("_m") - 2).alias("my"))
    return L.GramDesign(cut(table), cut(stats)), means


METHODS = {"niht": L.niht, "cosamp": L.cosamp, "iht": L.iht}


def _fitted(design: L.GramDesign, jobs: DataFrame, method: str, sizes: Sequence[int], max_epochs: int, tol: float) -> DataFrame:
    """Jobs of every sparsity ``s``, which is a column of ``jobs``."""
    out = None
    for s in sizes:
        one = METHODS[method](design, jobs.filter(F.col("s") == s), s, max_epochs=max_epochs, tol=tol)
        out = one if out is None else out.unionByName(one)
    return out


def _scored(rows: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    score = sparse_dot(F.col("x"), F.col("idx"), F.col("w")) + F.col("c")
    return rows.join(models, [P, "fold", "subfold"]).select(*keys, "y", score.alias("score"), F.when(score > 0, 1).otherwise(-1).alias("label"))


def nested_cv_fit(rows: DataFrame, grid: DataFrame, sizes: Sequence[int], k: int, sub_k: int, method: str = "niht", max_epochs: int = 500, tol: float = 1e-6) -> DataFrame:
    """X2. Sparse linear classifiers tuned on inner folds and judged on outer ones.

    ``rows(problem_id, row_id, x, y, fold, subfold)`` with ``y`` of -1 or 1, folds numbered from 0; ``grid(job_id, s[, lr])``
    holds the parameters, each with a number of its own, and ``sizes`` the values of ``s`` in it.  Weights come from
    ``method`` on centred columns; the intercept makes up for the means.  Per problem and outer fold the parameters of
    least balanced error, summed over inner folds, are chosen (the first on ties); the outer fold is reported at those:
    ``(problem_id, fold, job_id, s, ..., sub_bacc, n, auc, acc, bacc, n_weights, converged)``.

    A fold that is empty, or leaves nothing to train on, is not reported.  A class missing from a test fold has an error
    of 0 there, and the AUC is null.
    """
    params = [c for c in grid.columns if c != "job_id"]
    rows = cut(rows.select(P, "row_id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"),
                           F.col("subfold").cast("int").alias("subfold")))
    design, means = _design(training_sums(rows, k, sub_k))
    jobs = design.stats.filter("n > 0").select(P).crossJoin(F.broadcast(grid))  # the grid of parameters is a short literal list
    fitted = _fitted(design, jobs, method, sizes, max_epochs, tol).join(means, P)
    models = cut(fitted.select(
        F.col(f"{P}.{P}").alias(P), F.col(f"{P}.fold").alias("fold"), F.col(f"{P}.subfold").alias("subfold"), "job_id", *params, "idx", "w", "converged",
        (F.col("my") - sparse_dot(F.col("mx"), F.col("idx"), F.col("w"))).alias("c")))
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    validation = rows.select(P, "x", "y", "subfold", F.explode(others).alias("fold"))
    inner = classification_rates(_scored(validation, models, [P, "fold", "subfold", "job_id"]), [P, "fold", "subfold", "job_id"])
    summed = inner.groupBy(P, "fold", "job_id").agg(F.round(F.sum("balanced_error"), 12).alias("sub_bacc"))
    star = cut(best_parameter(summed, [P, "fold"], ["job_id", "sub_bacc"], "sub_bacc", ["job_id"]))
    final = cut(models.filter(F.col("subfold") == WHOLE).join(star, [P, "fold", "job_id"]))
    tested = cut(_scored(rows.withColumn("subfold", F.lit(WHOLE)), final, [P, "fold"]))
    rates = classification_rates(tested, [P, "fold"]).select(P, "fold", "n", F.col("accuracy").alias("acc"), F.col("balanced_error").alias("bacc"))
    return final.select(P, "fold", "job_id", *params, "sub_bacc", F.size("idx").alias("n_weights"), "converged").join(rates, [P, "fold"]).join(
        auc(tested, [P, "fold"]), [P, "fold"], "left")


def drawn_trials(rows: DataFrame, trials: DataFrame, sizes: Sequence[int], seed: int = 0) -> DataFrame:
    """Rows of every trial and sample size: the first ``n`` rows in an order drawn for the trial.

    ``rows(row_id, x)``, ``trials(trial)``.  Returns ``(trial, n, row_id, x)``.  Sample sizes are nested: a trial's
    smaller samples are part of its larger ones, and no more than the largest size of a trial is kept.
    """
    most = max(sizes)
    pairs = rows.select("row_id").crossJoin(F.broadcast(trials.select("trial")))  # ids alone, for a short list of trials
    order = ranked(pairs.withColumn("_draw", hashed(seed, "trial", "row_id")), ["trial"], [F.col("_draw"), F.col("row_id")], "_place")
    placed = order.filter(F.col("_place") <= most).drop("_draw").join(rows.select("row_id", "x"), "row_id")
    return placed.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes]))).filter("_place <= n").select("trial", "n", "row_id", "x", "_place")


def recovery_sweep(rows: DataFrame, trials: DataFrame, sizes: Sequence[int], s: int, methods: Sequence[str], tol: float = 1e-3, seed: int = 0,
                   max_epochs: int = 500, lr: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X4, X6. How many rows each method needs to find a sparse signal: errors, probability of recovery, least size.

    ``rows(row_id, x)``, ``trials(trial)`` with whole numbers of at least 0.  Every trial draws a signal of ``s`` weights of 1 on columns of its own and, for each size, that
    many rows; responses are exact.  Returns ``errors(trial, n, method, err, converged)``, the share of trials (trimmed
    by 5 % at each end) with an error of at most ``tol`` by method and size, and the least size recovered in all of them.
    """
    p = F.size("x")
    sample = cut(drawn_trials(rows, trials, sizes, seed))
    truth = cut(attach_row(trials.select("trial"), rows.select(F.max(p).alias("p"))).select("trial", F.array_sort(F.transform(F.slice(F.array_sort(F.transform(
        F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.struct(hashed(seed + 1, F.col("trial"), j).alias("d"), j.alias("j")))), 1, s), lambda t: t["j"])).alias("on")))
    wide = max(sizes) + 1  # a trial and a size are one problem
    response = F.aggregate("on", F.lit(0.0), lambda a, j: a + F.get("x", j))
    data = sample.join(truth, "trial").select((F.col("trial") * wide + F.col("n")).cast("long").alias(P), (F.col("_place") - 1).cast("long").alias("row_id"), "x", response.alias("y"))
    design = L.GramDesign.of(data)
    jobs = design.stats.select(P).withColumns({"job_id": F.lit(0), "s": F.lit(s), **({"lr": F.lit(lr)} if lr is not None else {})})
    parts = None
    for method in methods:
        one = _fitted(design, jobs, method, [s], max_epochs, 1e-9).withColumn("method", F.lit(method))
        parts = one if parts is None else parts.unionByName(one)
    apart = F.aggregate(F.map_values(F.map_zip_with(
        F.map_from_arrays("idx", "w"), F.map_from_arrays("on", F.transform("on", lambda j: F.lit(1.0))),
        lambda j, a, b: F.pow(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), F.lit(2.0)))), F.lit(0.0), lambda a, v: a + v)
    fitted = parts.select(F.floor(F.col(P) / wide).alias("trial"), (F.col(P) % wide).cast("int").alias("n"), "method", "idx", "w", "converged")
    errors = cut(fitted.join(truth, "trial").select("trial", "n", "method", F.sqrt(apart).alias("err"), "converged"))
    prob = recovery_probability(errors, ["method", "n"], tol)
    return errors, prob, least_sample_size(prob, ["method"])
