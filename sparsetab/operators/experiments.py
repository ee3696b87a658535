"""Tuning and analysis of trial results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparsetab.functions.scalar import recovered
from sparsetab.operators.ranking import padded_trace, trimmed_counts


def best_parameter(errors: DataFrame, keys: Sequence[str], params: Sequence[str], err: str, order: Sequence[str]) -> DataFrame:
    """X1. Parameters of least error per key, the first by ``order`` on ties."""
    best = F.min_by(F.struct(*params), F.struct(err, *order)).alias("_p")
    return errors.groupBy(*keys).agg(best).select(*keys, "_p.*")


def nested_cv(cv: DataFrame, keys: Sequence[str], params: Sequence[str]) -> DataFrame:
    """X2. Outer-fold result at the parameters chosen on the inner folds.

    ``cv(keys, subfold, params, auc, acc, bacc)``; a null ``subfold`` marks the
    outer fold.  Parameters are chosen by the summed balanced error, the least
    parameters first on ties.
    """
    keys, params = list(keys), list(params)
    inner = cv.filter("subfold is not null").groupBy(*keys, *params).agg(F.sum("bacc").alias("sub_bacc"))
    star = best_parameter(inner, keys, params, "sub_bacc", params)
    return cv.filter("subfold is null").join(star, [*keys, *params]).select(*keys, *params, "auc", "acc", "bacc")


def trial_matrix(trials: DataFrame, rows: Sequence[str], column: str, values: Sequence, cell: Column) -> DataFrame:
    """X3. One row per trial, one column per value of ``column``."""
    return trials.groupBy(*rows).pivot(column, list(values)).agg(cell)


def recovery_probability(trials: DataFrame, keys: Sequence[str], tol: float, ratio: float = 0.05, err: str = "err", zero_is_failure: bool = False) -> DataFrame:
    """X4. Share of trials within ``tol`` after a symmetric trim of every cell."""
    kept = trimmed_counts(trials, keys, err, ratio)
    hit = recovered(F.col(err), tol, zero_is_failure) * F.col("kept")
    return kept.groupBy(*keys).agg(
        (F.sum(hit) / F.sum("kept")).alias("prob"), F.sum("kept").alias("kept")
    )


def least_sample_size(prob: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """X6. Least ``n`` recovered in all kept trials, else the largest ``n``."""
    return prob.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("prob") == 1.0, F.col(n))), F.max(n)).alias(n)
    )


def spread_over(results: DataFrame, grid: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """X7. Results of methods that ignore ``column`` repeated for each of its values.

    ``grid(keys, column)`` lists the values the other methods ran with.
    """
    return grid.select(*keys, column).distinct().join(results.drop(column), list(keys), "left")


def error_curve(trace: DataFrame, keys: Sequence[str], cell: Sequence[str], length: int, ratio: float, step: str = "step", err: str = "err") -> DataFrame:
    """X8. Trimmed mean error by step and its decimal logarithm.

    ``keys`` name one trace, ``cell`` the part of them a curve is drawn for.
    """
    padded = padded_trace(trace, keys, step, err, length)
    kept = trimmed_counts(padded, [*cell, step], err, ratio, half_up=False)
    mean = kept.groupBy(*cell, step).agg((F.sum(F.col(err) * F.col("kept")) / F.sum("kept")).alias("mean_err"))
    return mean.withColumn("log10_err", F.when(F.col("mean_err") > 0, F.log10("mean_err")))


def best_method(table: DataFrame, keys: Sequence[str], method: str, value: str, order: Sequence[str], largest: bool = False) -> DataFrame:
    """X9. Best method per row, the first by ``order`` on ties."""
    score = -F.col(value) if largest else F.col(value)
    return table.groupBy(*keys).agg(F.min_by(method, F.struct(score, *order)).alias(method))


def win_counts(best: DataFrame, method: str) -> DataFrame:
    """X9."""
    return best.groupBy(method).agg(F.count(F.lit(1)).alias("wins"))


def mean_sd_table(trials: DataFrame, method: str, folding: str, value: str) -> DataFrame:
    """A2, X10. Mean and population deviation per method and folding and per method overall.

    The overall row has a null folding.
    """
    return trials.rollup(method, folding).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n_trials"),
        F.grouping(folding).alias("_all"), F.grouping(method).alias("_total"),
    ).filter("_total = 0").drop("_total", "_all")


def related_genes(weights: DataFrame, names: DataFrame, related: DataFrame, keys: Sequence[str]) -> DataFrame:
    """X11, A5. Distinct known genes among the nonzero columns of any fold.

    ``weights(keys, col_id, w)``, ``names(col_id, entrez)``, ``related(entrez, gene)``.
    """
    return (
        weights.filter("w <> 0").join(names, "col_id").join(related, "entrez")
        .select(*keys, "entrez", "gene").distinct()
    )


def weights_at(weights: DataFrame, chosen: DataFrame, keys: Sequence[str], param: str) -> DataFrame:
    """X12. Nonzero weights at the chosen parameter of every key."""
    return weights.join(chosen.select(*keys, param), [*keys, param]).filter("w <> 0")
