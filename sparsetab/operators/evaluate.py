"""Prediction and evaluation.

Input is ``scored(keys, y, score)``: response of +1 or -1 and a real score.
Rank statistics are computed from counts per distinct score, so neither ties
nor a dominant key end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sparsetab.functions.scalar import predicted_label, sigmoid
from sparsetab.operators.ranking import running_totals
from sparsetab.operators.relational import attach_row, sign_counts


def logistic_predict(margins: DataFrame, margin: str = "pred") -> DataFrame:
    """E1. Probability and class from ``x w + intercept``."""
    scored = margins.withColumn("prob", sigmoid(F.col(margin)))
    return scored.withColumn("label", predicted_label(F.col("prob")))


def classification_rates(predicted: DataFrame, keys: Sequence[str], y: str = "y", label: str = "label") -> DataFrame:
    """E3-E5, A11. Accuracy, error rate, missed classes and balanced error."""
    pos, neg = F.col(y) > 0, F.col(y) < 0
    wrong = F.col(y) != F.col(label)
    counts = predicted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("pos"), F.count_if(neg).alias("neg"),
        F.count_if(pos & wrong).alias("missed_pos"), F.count_if(neg & wrong).alias("missed_neg"),
        F.count_if(wrong).alias("wrong"),
    )
    one = F.lit(1)
    return counts.select(
        *keys, "n", "pos", "neg", "missed_pos", "missed_neg",
        (1 - F.col("wrong") / F.col("n")).alias("accuracy"), (F.col("wrong") / F.col("n")).alias("error_rate"),
        ((F.col("missed_pos") / F.greatest("pos", one) + F.col("missed_neg") / F.greatest("neg", one)) / 2).alias("balanced_error"),
    )


def _score_counts(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys, "score").agg(F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") < 0).alias("neg"))


def auc(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E6. Area under the ROC curve; ties count one half."""
    keys = list(keys)
    placed = running_totals(_score_counts(scored, keys), keys, "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))
    return placed.groupBy(*keys).agg((wins / pairs).alias("auc"))


def auc_error_bar(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E7. Error bar of the AUC at the best point of the approximate ROC curve.

    The negatives are walked from the best score down: the sensitivity there is
    the share of positives ranked before (ties by half), the specificity of the
    i-th is ``1 - (i - 1/2) / neg``.  Among negatives of one score the first has
    the largest sum, so one candidate per score is enough.
    """
    keys = list(keys)
    down = _score_counts(scored, keys).withColumn("down", -F.col("score"))
    placed = running_totals(down.select(*keys, "down", "pos", "neg"), keys, "down", ["pos", "neg"])
    totals = down.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    points = placed.filter("neg > 0").join(totals, keys).filter("all_pos > 0").select(
        *keys, "all_pos", "all_neg", "neg_before",
        ((F.col("pos_before") + F.col("pos") / 2) / F.col("all_pos")).alias("sen"),
        (1 - (F.col("neg_before") + 0.5) / F.col("all_neg")).alias("spe"),
    )
    best = points.groupBy(*keys).agg(
        F.min_by(F.struct("sen", "spe", "all_pos", "all_neg"), F.struct(-(F.col("sen") + F.col("spe")), "neg_before")).alias("b")
    ).select(*keys, "b.*")
    sigma = 0.5 * F.sqrt(
        F.col("sen") * (1 - F.col("sen")) / F.col("all_pos") + F.col("spe") * (1 - F.col("spe")) / F.col("all_neg")
    )
    return best.select(*keys, "sen", "spe", sigma.alias("sigma"))


def squared_errors(predicted: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """E8. Mean squared error and its class-balanced sum.

    In the balanced form the squares of each class are weighted by the share of
    the other class.
    """
    square = (F.col(pred) - F.col(y)) * (F.col(pred) - F.col(y))
    sums = predicted.groupBy(*keys).agg(
        F.avg(square).alias("mse"), F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(y) > 0).alias("_p"), F.count_if(F.col(y) < 0).alias("_m"),
        F.sum(F.when(F.col(y) > 0, square).otherwise(0.0)).alias("_sp"), F.sum(F.when(F.col(y) < 0, square).otherwise(0.0)).alias("_sm"),
    )
    balanced = F.col("_m") / F.col("_n") * F.col("_sp") + F.col("_p") / F.col("_n") * F.col("_sm")
    return sums.select(*keys, "mse", balanced.alias("balanced_sse"))


def validation_error(predicted: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """E9. Squared norm of ``y - X w``."""
    gap = F.col(y) - F.col(pred)
    return predicted.groupBy(*keys).agg(F.sum(gap * gap).alias("err"))


def method_report(predicted: DataFrame, weights: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E10. One row per method: rates, AUC, F1, node scores and sign counts.

    ``predicted(keys, y, score, label)``, ``weights(keys, node, w)``, ``truth(node)``.
    """
    keys = list(keys)
    rates = classification_rates(predicted, keys)
    hits = F.col("pos") - F.col("missed_pos")
    f1 = F.when(2 * hits + F.col("missed_pos") + F.col("missed_neg") > 0, 2 * hits / (2 * hits + F.col("missed_pos") + F.col("missed_neg"))).otherwise(0.0)
    marked = weights.filter("w <> 0").join(truth.select("node").distinct().withColumn("_t", F.lit(1)), "node", "left")
    found = attach_row(
        marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"), F.count("_t").alias("hit")),
        truth.agg(F.count_distinct("node").alias("truth")),
    )
    both = F.col("found") + F.col("truth")
    nodes = found.select(
        *keys, (F.col("hit") / F.col("found")).alias("n_pre"),
        F.when(F.col("truth") > 0, F.col("hit") / F.col("truth")).otherwise(0.0).alias("n_rec"),
        F.when(F.col("hit") > 0, 2 * F.col("hit") / both).otherwise(0.0).alias("n_fm"),
    )
    return (
        rates.withColumn("f1", f1).join(auc(predicted, keys), keys)
        .join(nodes, keys, "left").fillna(0.0, ["n_pre", "n_rec", "n_fm"])
        .join(sign_counts(weights, truth, keys), keys)
    )
