"""Queries for matrices, feature groups, splits, evaluation, tuning and trial analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsetab.operators import evaluate as E, experiments as X, groups as C, matrix as M, ranking as W, relational as R
from sparsetab.plans.inputs import CELLS, SCORED, TRIALS, TRIMMED, cells, label_problems, matrix_rows, query, r6, response, scored, small_weights, table, trials
from sparsetab.plans.relational import _TRACE, _trace

W_SQL = "CASE WHEN col_id % 2 = 0 THEN 0.01 ELSE -0.01 END"

# -- matrix ------------------------------------------------------------------------

@query("m1_matvec", f"WITH {CELLS} SELECT row_id, round(sum(value / (col_id + 1)), 6) AS pred FROM cells GROUP BY row_id")
def m1(spark, sf):
    x = cells(spark, sf)
    w = x.select("col_id").distinct().withColumn("w", 1.0 / (F.col("col_id") + 1))
    return M.matvec(x, w).select("row_id", r6(F.col("pred"), "pred"))


@query("m2_transposed_matvec", f"WITH {CELLS} SELECT col_id, round(sum(value * y), 6) AS total FROM cells JOIN resp USING (row_id) GROUP BY col_id")
def m2(spark, sf):
    return M.vector_sums(matrix_rows(spark, sf), ["problem_id"], "x", F.col("y")).select(F.posexplode("sums").alias("col_id", "total")).select("col_id", r6(F.col("total"), "total"))


@query("m3_gram", f"WITH {CELLS} SELECT a.col_id AS i, b.col_id AS j, round(sum(a.value * b.value), 6) AS value FROM cells a JOIN cells b USING (row_id) GROUP BY 1, 2")
def m3(spark, sf):
    return M.gram_cells(matrix_rows(spark, sf), ["problem_id"]).select("i", "j", r6(F.col("value"), "value"))


@query("m4_row_blocks", f"""WITH {CELLS}, n AS (SELECT count(*) AS n FROM resp) SELECT row_id // 64 AS block, count(*) AS rows, CAST(sum(y) AS DOUBLE) AS total
FROM resp, n WHERE row_id // 64 < n // 64 GROUP BY 1""")
def m4(spark, sf):
    rows = response(spark, sf)
    total = R.attach_row(rows, rows.agg(F.count(F.lit(1)).alias("n")))
    placed = M.row_blocks(total, F.col("n"), F.lit(64)).filter("block is not null")
    return placed.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("total"))


@query("m5_block_choice", """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, n, epoch, step, CASE WHEN n >= 8 THEN CAST('0x' || substr(md5(concat_ws('|', '7', user_id, epoch, step)), 1, 13) AS BIGINT) % CAST(floor(n / 8) AS BIGINT) END AS block
FROM u, (SELECT unnest([0, 1])::INTEGER AS epoch), (SELECT unnest([0, 1, 2, 3])::INTEGER AS step)""")
def m5(spark, sf):
    users = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    steps = R.parameter_grid(users, {"epoch": [0, 1], "step": [0, 1, 2, 3]})
    return steps.withColumn("block", M.chosen_block(7, F.col("epoch"), F.col("step"), F.floor(F.col("n") / 8), "user_id"))


@query("m6_zscore", f"""WITH {CELLS}, s AS (SELECT col_id, avg(value) AS m, stddev_pop(value) AS sd FROM cells GROUP BY col_id)
SELECT row_id, col_id, round(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END, 6) AS value FROM cells JOIN s USING (col_id)""")
def m6(spark, sf):
    return M.zscore(cells(spark, sf)).select("row_id", "col_id", r6(F.col("value"), "value"))


@query("m7_unit_columns", f"""WITH {CELLS}, s AS (SELECT col_id, avg(value) AS m, stddev_pop(value) * sqrt(count(*)) AS sc FROM cells GROUP BY col_id)
SELECT row_id, col_id, round((value - m) / sc, 6) AS value FROM cells JOIN s USING (col_id) WHERE sc >= 1e-6""")
def m7(spark, sf):
    x = cells(spark, sf)
    return M.scale_columns(x, M.unit_columns(x)).select("row_id", "col_id", r6(F.col("value"), "value"))


@query("m8_correlations", f"WITH {CELLS} SELECT col_id, round(corr(value, y), 6) AS r FROM cells JOIN resp USING (row_id) GROUP BY col_id")
def m8(spark, sf):
    return M.column_correlations(cells(spark, sf), response(spark, sf)).select("col_id", r6(F.col("r"), "r"))


@query("t6_top_correlated", f"WITH {CELLS}, c AS (SELECT col_id, round(corr(value, y), 6) AS r FROM cells JOIN resp USING (row_id) GROUP BY col_id) SELECT col_id, r FROM c ORDER BY abs(r) DESC, col_id LIMIT 10")
def t6(spark, sf):
    r = M.column_correlations(cells(spark, sf), response(spark, sf)).select("col_id", r6(F.col("r"), "r"))
    return r.orderBy(F.abs("r").desc(), "col_id").limit(10)


def _groups(spark, sf):
    """Overlapping groups: columns by remainder of 4 and of 6."""
    cols = cells(spark, sf).select("col_id").distinct()
    return cols.select("col_id", F.explode(F.array(F.col("col_id") % 4, F.col("col_id") % 6 + 4)).alias("group_id"))


_GROUPS = "grp AS (SELECT DISTINCT col_id, col_id % 4 AS group_id FROM cells UNION ALL SELECT DISTINCT col_id, col_id % 6 + 4 FROM cells)"


@query("m9_overlap_expansion", f"""WITH {CELLS}, {_GROUPS}, x AS (SELECT row_id, group_id, col_id, value FROM cells JOIN grp USING (col_id))
SELECT row_id, col_id, round(sum(value * (group_id + 1)), 6) AS w FROM x GROUP BY row_id, col_id""")
def m9(spark, sf):
    copies = M.expand_groups(cells(spark, sf), _groups(spark, sf))
    return M.fold_back(copies.withColumn("w", F.col("value") * (F.col("group_id") + 1)), ["row_id"]).select("row_id", "col_id", r6(F.col("w"), "w"))


@query("m10_least_squares", None)
def m10(spark, sf):
    from sparsetab.operators.fit import GramDesign

    design = GramDesign.of(label_problems(spark, sf))
    top = design.table.filter("block = -1").select("problem_id", F.lit(0).alias("job_id"), F.col("i").alias("col_id"), "xty")
    picked = W.top_k(top, ["problem_id", "job_id"], W.by_magnitude("xty", "col_id"), 10).groupBy("problem_id", "job_id").agg(F.collect_set("col_id").alias("idx"))
    return M.solve_normal(design.normal_on(picked), ["problem_id", "job_id"]).select("problem_id", F.col("idx").alias("col_id"), r6(F.col("w"), "w"))


_TOP = f"""c AS (SELECT l.problem_id, col_id, sum(value * CASE WHEN label = l.problem_id THEN 1.0 ELSE -1.0 END) AS t FROM cells JOIN embeddings ON vec_id = row_id,
(SELECT DISTINCT CAST(label AS BIGINT) AS problem_id FROM embeddings) l GROUP BY 1, 2), top AS (SELECT problem_id, col_id FROM c QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY abs(t) DESC, col_id) <= 10)"""


@query("m10_least_squares_qr", f"""WITH {CELLS}, {_TOP} SELECT problem_id, col_id, 0.0::DOUBLE AS slope, 10 AS rank FROM top""")
def m10_qr(spark, sf):
    """Weights on the ten columns nearest the response, proved by the slope of the loss there: 0 in every column."""
    from sparsetab.operators import tall

    rows = label_problems(spark, sf)
    sums = M.vector_sums(rows, ["problem_id"], "x", F.col("y")).select("problem_id", F.posexplode("sums").alias("col_id", "t"))
    top = W.top_k(sums, ["problem_id"], W.by_magnitude("t", "col_id"), 10).groupBy("problem_id").agg(F.array_sort(F.collect_set("col_id")).alias("cols"))
    limited = rows.join(top, "problem_id").select("problem_id", "cols", F.transform("cols", lambda c: F.get(F.col("x"), c)).alias("x"), "y")
    solved = tall.least_squares(limited, ["problem_id"])
    gap = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) - F.col("y")
    slope = M.vector_sums(limited.join(solved, "problem_id").select("problem_id", "x", gap.alias("gap")), ["problem_id"], "x", F.col("gap"))
    return slope.join(top, "problem_id").join(solved, "problem_id").select(
        "problem_id", F.explode(F.arrays_zip("cols", "sums")).alias("e"), "rank").select(
        "problem_id", F.col("e.cols").alias("col_id"), (F.round("e.sums", 6) + 0.0).alias("slope"), "rank")


@query("m12_trace_norms_qr", None)
def m12_qr(spark, sf):
    from sparsetab.operators import tall

    return tall.trace_norms(matrix_rows(spark, sf), _groups(spark, sf)).select("group_id", r6(F.col("norm"), "norm"), r6(F.col("weight"), "weight"))


@query("m3_tiled_gram", f"WITH {CELLS} SELECT a.col_id AS i, b.col_id AS j, round(sum(a.value * b.value), 6) AS value FROM cells a JOIN cells b USING (row_id) GROUP BY 1, 2")
def m3_tiled(spark, sf):
    """The Gram matrix by tiles of 24 columns."""
    from sparsetab.operators import tall

    return tall.tiled_gram(matrix_rows(spark, sf), ["problem_id"], tile=24).select("i", F.posexplode("sums").alias("j", "value")).select("i", "j", r6(F.col("value"), "value"))


@query("m11_restrict", f"WITH {CELLS} SELECT row_id, col_id, round(value, 6) AS value FROM cells WHERE row_id IN (SELECT row_id FROM resp WHERE y > 0) AND col_id IN (SELECT col_id FROM cells GROUP BY col_id HAVING avg(value) > 0)")
def m11(spark, sf):
    x = cells(spark, sf)
    cols = x.groupBy("col_id").agg(F.avg("value").alias("m")).filter("m > 0")
    return M.restrict(x, cols, response(spark, sf).filter("y > 0")).select("row_id", "col_id", r6(F.col("value"), "value"))


@query("m12_trace_norms", None)
def m12(spark, sf):
    g = M.gram(matrix_rows(spark, sf), ["problem_id"])
    return M.trace_norms(g, _groups(spark, sf)).select("group_id", r6(F.col("norm"), "norm"), r6(F.col("weight"), "weight"))


@query("m13_group_gradient", f"""WITH {CELLS}, {_GROUPS}, p AS (SELECT row_id, sum(value * ({W_SQL})) AS z FROM cells GROUP BY row_id),
g AS (SELECT col_id, 2 * sum(value * (z - y)) / (SELECT count(*) FROM resp) AS gradient FROM cells JOIN p USING (row_id) JOIN resp USING (row_id) GROUP BY col_id)
SELECT group_id, round(sqrt(sum(gradient * gradient)), 6) AS norm FROM g JOIN grp USING (col_id) GROUP BY group_id""")
def m13(spark, sf):
    gradient = _one_step(spark, sf, "squared").filter("col_id >= 0")
    return M.group_gradient_norms(gradient, _groups(spark, sf)).select("group_id", r6(F.col("norm"), "norm"))


@query("m14_unpivot_measures", f"""WITH {CELLS}, m AS (SELECT row_id, col_id // 4 AS sample_id, col_id % 4 AS k, value FROM cells)
SELECT row_id, CAST(sample_id + 100 AS INTEGER) AS sample_id, round(max(value) FILTER (k = 0), 6) AS log_ratio, round(max(value) FILTER (k = 1), 6) AS err, round(max(value) FILTER (k = 2), 6) AS p_value, round(max(value) FILTER (k = 3), 6) AS flag FROM m GROUP BY 1, 2""")
def m14(spark, sf):
    names = ["log_ratio", "err", "p_value", "flag"]
    long = M.unpivot_measures(matrix_rows(spark, sf), ["row_id"], "x", names, F.lit(100))
    return long.select("row_id", "sample_id", *[r6(F.col(m), m) for m in names])


# -- groups and splits -----------------------------------------------------------------

@query("c1_edge_groups", "SELECT 2 * p_partkey AS a, NULL::BIGINT AS b FROM part UNION ALL SELECT DISTINCT 2 * l_partkey, 2 * l_suppkey + 1 FROM lineitem")
def c1(spark, sf):
    nodes = table(spark, sf, "part").select((F.col("p_partkey") * 2).alias("node"))
    edges = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return C.edge_groups(nodes, edges).select(F.get("members", F.lit(0)).alias("a"), F.get("members", F.lit(1)).alias("b"))


@query("c2_square_groups", f"""WITH {CELLS}, h AS (SELECT count(*) AS h FROM embeddings) SELECT row_id * 64 + col_id AS a, row_id * 64 + col_id + 1 AS b, row_id * 64 + col_id + 64 AS c, row_id * 64 + col_id + 65 AS d
FROM cells, h WHERE col_id + 1 < 64 AND row_id + 1 < h""")
def c2(spark, sf):
    at = cells(spark, sf).select(F.col("row_id").alias("r"), F.col("col_id").alias("c"))
    tall = R.attach_row(at, table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("h")))
    sq = C.square_groups(tall, 64, F.col("h"))
    return sq.select(*[F.get("members", F.lit(i)).alias(n) for i, n in enumerate("abcd")])


@query("c3_pathway_groups", "SELECT DISTINCT p_size AS group_id, p_partkey AS col_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def c3(spark, sf):
    paths = table(spark, sf, "part").select(F.col("p_size").alias("pathway_id"), F.col("p_partkey").alias("entrez"))
    seen = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("entrez"), F.col("l_partkey").alias("col_id")).distinct()
    return C.pathway_groups(paths, seen)


@query("c4_singleton_groups", "SELECT p_partkey AS group_id, p_partkey AS col_id FROM part")
def c4(spark, sf):
    return C.singleton_groups(table(spark, sf, "part").select(F.col("p_partkey").alias("col_id")))


_FOLD = "least(floor((row_number() OVER ({0}) - 1) / greatest(round(count(*) OVER ({1}) / {2}), 1)), {2} - 1)::INTEGER"
_MD5 = "md5(CAST(doc_id AS VARCHAR)), doc_id"


def _md5(prefix=""):
    return [F.md5(F.concat(F.lit(prefix), F.col("doc_id").cast("string"))), F.col("doc_id")]


@query("c5_kfold", f"SELECT doc_id, {_FOLD.format('ORDER BY ' + _MD5, '', 5)} AS fold FROM documents")
def c5(spark, sf):
    return C.kfold(table(spark, sf, "documents").select("doc_id"), 5, _md5())


@query("c6_stratified_kfold", f"SELECT doc_id, quality, {_FOLD.format('PARTITION BY quality ORDER BY ' + _MD5, 'PARTITION BY quality', 5)} AS fold FROM labels")
def c6(spark, sf):
    return C.kfold(table(spark, sf, "labels").select("doc_id", "quality"), 5, _md5(), ["quality"]).select("doc_id", "quality", "fold")


@query("c7_nested_folds", f"""WITH o AS (SELECT doc_id, quality, {_FOLD.format('PARTITION BY quality ORDER BY ' + _MD5, 'PARTITION BY quality', 5)} AS tf FROM labels),
e AS (SELECT doc_id, quality, tf, CAST(unnest(range(5)) AS INTEGER) AS fold FROM o),
i AS (SELECT doc_id, quality, fold, {_FOLD.format("PARTITION BY fold, quality ORDER BY md5('i' || CAST(doc_id AS VARCHAR)), doc_id", 'PARTITION BY fold, quality', 5)} AS subfold FROM e WHERE fold <> tf)
SELECT * FROM i UNION ALL SELECT doc_id, quality, fold, NULL FROM e WHERE fold = tf""")
def c7(spark, sf):
    return C.nested_folds(table(spark, sf, "labels").select("doc_id", "quality"), 5, 5, _md5(), _md5("i"), ["quality"]).select("doc_id", "quality", "fold", "subfold")


@query("c8_contiguous_folds", "SELECT o_orderkey, CASE WHEN o_orderkey // 1000 < 5 THEN (o_orderkey // 1000)::INTEGER END AS fold FROM orders")
def c8(spark, sf):
    return C.contiguous_folds(table(spark, sf, "orders").select("o_orderkey"), 5, 1000, "o_orderkey")


@query("c9_validation_split", """SELECT user_id AS trial, event_id AS row_id,
CASE WHEN CAST('0x' || substr(md5(concat_ws('|', '11', user_id, event_id)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < 0.2 THEN 'validation' ELSE 'train' END AS role FROM events""")
def c9(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("trial"), F.col("event_id").alias("row_id"))
    return C.validation_split(rows, 0.2, 11, ["trial"])


# -- losses -------------------------------------------------------------------------------

def _weights(spark, sf):
    w = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.when(i % 2 == 0, 0.01).otherwise(-0.01))
    return matrix_rows(spark, sf).select("problem_id", w.alias("w")).groupBy("problem_id").agg(F.max("w").alias("w")).withColumn("c", F.lit(0.0))


def _one_step(spark, sf, loss):
    from sparsetab.operators.fit import loss_and_gradient

    return loss_and_gradient(matrix_rows(spark, sf), _weights(spark, sf), loss, curvature=True)


_MARGIN = f"m AS (SELECT row_id, sum(value * ({W_SQL})) AS z FROM cells GROUP BY row_id), r AS (SELECT row_id, z, y, y * z AS yz FROM m JOIN resp USING (row_id))"
_STEP = """SELECT c.col_id, round((SELECT avg(l) FROM t), 6) AS loss, round(sum(c.value * g) / (SELECT count(*) FROM t), 6) AS gradient, round(sum(c.value * c.value * h) / (SELECT count(*) FROM t), 6) AS hessian
FROM cells c JOIN t USING (row_id) GROUP BY c.col_id UNION ALL SELECT -1, round(avg(l), 6), round(avg(g), 6), round(avg(h), 6) FROM t"""


def _rounded_step(spark, sf, loss):
    s = _one_step(spark, sf, loss)
    return s.select("col_id", r6(F.col("loss"), "loss"), r6(F.col("gradient"), "gradient"), r6(F.col("hessian"), "hessian"))


@query("l1_squared_step", f"WITH {CELLS}, {_MARGIN}, t AS (SELECT row_id, (z - y) * (z - y) AS l, 2 * (z - y) AS g, 2.0 AS h FROM r) {_STEP}")
def l1(spark, sf):
    return _rounded_step(spark, sf, "squared")


@query("l2_logistic_step", f"WITH {CELLS}, {_MARGIN}, t AS (SELECT row_id, ln(1 + exp(-yz)) AS l, -y / (1 + exp(yz)) AS g, exp(yz) / ((1 + exp(yz)) * (1 + exp(yz))) AS h FROM r) {_STEP}")
def l2(spark, sf):
    return _rounded_step(spark, sf, "logistic")


@query("l3_balanced_step", f"""WITH {CELLS}, {_MARGIN}, k AS (SELECT avg(CASE WHEN y < 0 THEN 1.0 ELSE 0.0 END) AS cp, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS cn FROM resp),
s AS (SELECT r.*, CASE WHEN y > 0 THEN cp ELSE cn END AS q FROM r, k),
t AS (SELECT row_id, q * ln(1 + exp(-yz)) AS l, -q * y / (1 + exp(yz)) AS g, q * exp(yz) / ((1 + exp(yz)) * (1 + exp(yz))) AS h FROM s) {_STEP}""")
def l3(spark, sf):
    return _rounded_step(spark, sf, "balanced")


# -- evaluation ---------------------------------------------------------------------------

def _predicted(spark, sf):
    x = cells(spark, sf)
    pred = M.matvec(x, x.select("col_id").distinct().select("col_id", small_weights())).join(response(spark, sf), "row_id")
    return pred.withColumn("k", F.lit(0))


_PRED = f"pr AS (SELECT row_id, sum(value * ({W_SQL})) AS pred FROM cells GROUP BY row_id), p AS (SELECT * FROM pr JOIN resp USING (row_id))"


@query("e1_logistic_predict", f"WITH {CELLS}, {_PRED} SELECT row_id, round(1 / (1 + exp(-pred)), 6) AS prob, CASE WHEN pred < 0 THEN -1 ELSE 1 END AS label FROM p")
def e1(spark, sf):
    return E.logistic_predict(_predicted(spark, sf)).select("row_id", r6(F.col("prob"), "prob"), "label")


@query("e2_linear_predict", f"WITH {CELLS}, {_PRED} SELECT row_id, round(pred + 0.5, 6) AS pred FROM p")
def e2(spark, sf):
    return _predicted(spark, sf).select("row_id", r6(F.col("pred") + 0.5, "pred"))


_RATES = """SELECT count(*) AS n, round(avg(CASE WHEN y = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN y <> label THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
count(*) FILTER (y > 0 AND y <> label) AS missed_pos, count(*) FILTER (y < 0 AND y <> label) AS missed_neg,
round((count(*) FILTER (y > 0 AND y <> label) / greatest(count(*) FILTER (y > 0), 1) + count(*) FILTER (y < 0 AND y <> label) / greatest(count(*) FILTER (y < 0), 1)) / 2, 6) AS balanced_error FROM q"""


def _rates(spark, sf):
    return E.classification_rates(E.logistic_predict(_predicted(spark, sf)), ["k"])


_Q = f"WITH {CELLS}, {_PRED}, q AS (SELECT y, CASE WHEN pred < 0 THEN -1 ELSE 1 END AS label FROM p)"


@query("e3_accuracy", f"{_Q} SELECT round(avg(CASE WHEN y = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM q")
def e3(spark, sf):
    return _rates(spark, sf).select(r6(F.col("accuracy"), "accuracy"))


@query("e4_error_rate", f"{_Q} SELECT round(avg(CASE WHEN y <> label THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM q")
def e4(spark, sf):
    return _rates(spark, sf).select(r6(F.col("error_rate"), "error_rate"))


@query("e5_balanced_error", f"{_Q} {_RATES}")
def e5(spark, sf):
    return _rates(spark, sf).select("n", "missed_pos", "missed_neg", *[r6(F.col(c), c) for c in ("accuracy", "error_rate", "balanced_error")])


@query("a11_missed_counts", f"{_Q} SELECT count(*) FILTER (y > 0) AS pos, count(*) FILTER (y > 0 AND label <> 1) AS missed_pos, count(*) FILTER (y < 0) AS neg, count(*) FILTER (y < 0 AND label <> -1) AS missed_neg FROM q")
def a11(spark, sf):
    return _rates(spark, sf).select("pos", "missed_pos", "neg", "missed_neg")


_AUC = """rk AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mr FROM scored),
ct AS (SELECT count(*) FILTER (y > 0) AS np, count(*) FILTER (y < 0) AS nn FROM scored)"""


@query("e6_auc", f"WITH {SCORED}, {_AUC} SELECT round((sum(mr) FILTER (y > 0) - any_value(np) * (any_value(np) + 1) / 2) / (any_value(np) * any_value(nn)), 6) AS auc FROM rk, ct")
def e6(spark, sf):
    return E.auc(scored(spark, sf), ["k"]).select(r6(F.col("auc"), "auc"))


@query("e7_auc_error_bar", f"""WITH {SCORED}, ct AS (SELECT count(*) FILTER (y > 0) AS np, count(*) FILTER (y < 0) AS nn FROM scored),
ng AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS i FROM scored WHERE y < 0),
pt AS (SELECT i, ((SELECT count(*) FROM scored s WHERE s.y > 0 AND s.score > ng.score) + (SELECT count(*) FROM scored s WHERE s.y > 0 AND s.score = ng.score) / 2) / np AS sen, 1 - (i - 0.5) / nn AS spe, np, nn FROM ng, ct),
b AS (SELECT * FROM pt ORDER BY round(sen + spe, 12) DESC, i LIMIT 1)
SELECT round(sen, 6) AS sen, round(spe, 6) AS spe, round(0.5 * sqrt(sen * (1 - sen) / np + spe * (1 - spe) / nn), 6) AS sigma FROM b""")
def e7(spark, sf):
    return E.auc_error_bar(scored(spark, sf), ["k"]).select(*[r6(F.col(c), c) for c in ("sen", "spe", "sigma")])


@query("e8_squared_errors", f"""WITH {CELLS}, {_PRED} SELECT round(avg((pred - y) * (pred - y)), 6) AS mse,
round(avg(CASE WHEN y < 0 THEN 1.0 ELSE 0.0 END) * sum((pred - y) * (pred - y)) FILTER (y > 0) + avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) * sum((pred - y) * (pred - y)) FILTER (y < 0), 5) AS balanced_sse FROM p""")
def e8(spark, sf):
    return E.squared_errors(_predicted(spark, sf), ["k"]).select(r6(F.col("mse"), "mse"), F.round("balanced_sse", 5).alias("balanced_sse"))


@query("e9_validation_error", f"WITH {CELLS}, {_PRED} SELECT round(sum((y - pred) * (y - pred)), 5) AS err FROM p")
def e9(spark, sf):
    return E.validation_error(_predicted(spark, sf), ["k"]).select(F.round("err", 5).alias("err"))


@query("e10_method_report", f"""WITH {SCORED}, {_AUC}, q AS (SELECT y, CASE WHEN score < 0 THEN -1 ELSE 1 END AS label FROM scored),
c AS (SELECT count(*) FILTER (y > 0 AND label > 0) AS tp, count(*) FILTER (y < 0 AND label > 0) AS fp, count(*) FILTER (y > 0 AND label < 0) AS fn, count(*) FILTER (y < 0 AND label < 0) AS tn FROM q),
f AS (SELECT count(*) FILTER (p_retailprice > 1500) AS found, count(*) FILTER (p_size > 25) AS truth, count(*) FILTER (p_retailprice > 1500 AND p_size > 25) AS hit FROM part)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
(SELECT round((sum(mr) FILTER (y > 0) - any_value(np) * (any_value(np) + 1) / 2) / (any_value(np) * any_value(nn)), 6) FROM rk, ct) AS auc,
round(CASE WHEN found > 0 THEN hit / found ELSE 0 END, 6) AS n_pre, round(hit / truth, 6) AS n_rec, round(CASE WHEN hit > 0 THEN 2 * hit / (found + truth) ELSE 0 END, 6) AS n_fm, hit AS posi_in, found - hit AS posi_out FROM c, f""")
def e10(spark, sf):
    predicted = scored(spark, sf).withColumn("label", F.when(F.col("score") < 0, -1).otherwise(1))
    part = table(spark, sf, "part")
    weights = part.select(F.explode(F.array(F.lit(0))).alias("k"), F.col("p_partkey").alias("node"), F.when(F.col("p_retailprice") > 1500, 1.0).otherwise(0.0).alias("w"))
    truth = part.filter("p_size > 25").select(F.col("p_partkey").alias("node"))
    rep = E.method_report(predicted, weights, truth, ["k"])
    return rep.select(*[r6(F.col(c), c) for c in ("accuracy", "f1", "auc", "n_pre", "n_rec", "n_fm")], "posi_in", "posi_out")


# -- tuning and trials ------------------------------------------------------------------------

@query("x1_best_parameter", """SELECT l_returnflag AS method, arg_min(l_linenumber, (e, l_linenumber, l_linestatus)) AS s, arg_min(l_linestatus, (e, l_linenumber, l_linestatus)) AS b
FROM (SELECT l_returnflag, l_linenumber, l_linestatus, round(avg(l_tax), 4) AS e FROM lineitem GROUP BY ALL) GROUP BY 1""")
def x1(spark, sf):
    err = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("s"), F.col("l_linestatus").alias("b")).agg(F.round(F.avg("l_tax"), 4).alias("e"))
    return X.best_parameter(err, ["method"], ["s", "b"], "e", ["s", "b"])


@query("x2_nested_cv", """WITH cv AS (SELECT l_returnflag AS method, l_suppkey % 5 AS fold, CASE WHEN l_linestatus = 'O' THEN l_quantity END AS subfold, l_linenumber AS s, avg(l_discount) AS auc, avg(l_tax) AS bacc, avg(l_extendedprice) AS acc FROM lineitem GROUP BY ALL),
i AS (SELECT method, fold, s, round(sum(bacc), 9) AS sb FROM cv WHERE subfold IS NOT NULL GROUP BY ALL), b AS (SELECT method, fold, arg_min(s, (sb, s)) AS s FROM i GROUP BY 1, 2)
SELECT method, fold, s, round(auc, 6) AS auc, round(acc, 4) AS acc, round(bacc, 6) AS bacc FROM cv JOIN b USING (method, fold, s) WHERE subfold IS NULL""")
def x2(spark, sf):
    line = table(spark, sf, "lineitem")
    cv = line.groupBy(F.col("l_returnflag").alias("method"), (F.col("l_suppkey") % 5).alias("fold"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("subfold"), F.col("l_linenumber").alias("s")).agg(
        F.avg("l_discount").alias("auc"), F.avg("l_tax").alias("bacc"), F.avg("l_extendedprice").alias("acc"))
    best = X.nested_cv(cv, ["method", "fold"], ["s"])
    return best.select("method", "fold", "s", r6(F.col("auc"), "auc"), F.round("acc", 4).alias("acc"), r6(F.col("bacc"), "bacc"))


@query("x3_trial_matrix", f"WITH {TRIALS} SELECT user_id, method, " + ", ".join(f"round(avg(err) FILTER (n = {d}), 6) AS n{d}" for d in range(1, 32)) + " FROM trials GROUP BY 1, 2")
def x3(spark, sf):
    wide = X.trial_matrix(trials(spark, sf), ["user_id", "method"], "n", range(1, 32), F.round(F.avg("err"), 6))
    return wide.withColumnsRenamed({str(d): f"n{d}" for d in range(1, 32)})


@query("x4_recovery_probability", f"WITH {TRIMMED} SELECT method, n, round(avg(CASE WHEN err <= 20 THEN 1.0 ELSE 0.0 END), 6) AS prob, count(*) AS kept FROM kept GROUP BY 1, 2")
def x4(spark, sf):
    return X.recovery_probability(trials(spark, sf), ["method", "n"], 20.0).select("method", "n", r6(F.col("prob"), "prob"), "kept")


@query("x5_oversampling", f"WITH {TRIMMED}, s AS (SELECT method, count(DISTINCT user_id) AS s FROM trials GROUP BY 1) SELECT method, n, round(avg(CASE WHEN err <= 20 THEN 1.0 ELSE 0.0 END), 6) AS prob, round(n / any_value(s), 6) AS ratio FROM kept JOIN s USING (method) GROUP BY 1, 2")
def x5(spark, sf):
    t = trials(spark, sf)
    size = t.groupBy("method").agg(F.count_distinct("user_id").alias("s"))
    return X.recovery_probability(t, ["method", "n"], 20.0).join(size, "method").select("method", "n", r6(F.col("prob"), "prob"), r6(F.col("n") / F.col("s"), "ratio"))


@query("x6_least_sample_size", f"""WITH {TRIMMED}, p AS (SELECT method, n, avg(CASE WHEN err <= 270 THEN 1.0 ELSE 0.0 END) AS prob FROM kept GROUP BY 1, 2)
SELECT method, coalesce(min(n) FILTER (prob = 1), max(n)) AS n FROM p GROUP BY 1""")
def x6(spark, sf):
    return X.least_sample_size(X.recovery_probability(trials(spark, sf), ["method", "n"], 270.0), ["method"])


@query("x7_spread_methods", f"WITH {TRIALS}, r AS (SELECT method, round(avg(err), 6) AS err FROM trials GROUP BY 1), g AS (SELECT DISTINCT method, n AS b FROM trials) SELECT method, b, err FROM g JOIN r USING (method)")
def x7(spark, sf):
    t = trials(spark, sf)
    once = t.groupBy("method").agg(r6(F.avg("err"), "err")).withColumn("b", F.lit(2))
    return X.spread_over(once, t.select("method", F.col("n").alias("b")), "b", ["method"])


@query("x8_error_curve", f"""WITH {_TRACE}, grid AS (SELECT user_id, unnest(range(80)) AS step FROM (SELECT DISTINCT user_id FROM events)),
pad AS (SELECT g.user_id, g.step, last_value(t.err IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.step) AS err FROM grid g LEFT JOIN trace t ON t.user_id = g.user_id AND t.step = g.step),
o AS (SELECT step, err, row_number() OVER (PARTITION BY step ORDER BY err, user_id) AS rn, count(*) OVER (PARTITION BY step) AS c FROM pad)
SELECT step, round(avg(err), 6) AS mean_err, round(log10(avg(err)), 6) AS log10_err FROM o WHERE rn > floor(0.05 * c) AND rn <= c - floor(0.05 * c) GROUP BY step""")
def x8(spark, sf):
    t = _trace(spark, sf).select("user_id", "step", "err")
    return X.error_curve(t, ["user_id"], [], 80, 0.05).select("step", r6(F.col("mean_err"), "mean_err"), r6(F.col("log10_err"), "log10_err"))


@query("x9_win_counts", f"""WITH {TRIALS}, m AS (SELECT user_id, n, method, round(avg(err), 4) AS e FROM trials GROUP BY ALL), b AS (SELECT user_id, n, arg_min(method, (e, method)) AS method FROM m GROUP BY 1, 2)
SELECT method, count(*) AS wins FROM b GROUP BY 1""")
def x9(spark, sf):
    cell = trials(spark, sf).groupBy("user_id", "n", "method").agg(F.round(F.avg("err"), 4).alias("e"))
    return X.win_counts(X.best_method(cell, ["user_id", "n"], "method", "e", ["method"]), "method")


_METHODS = ["click", "error", "purchase", "signup", "view"]  # columns of the matrix


@query("x10_results_matrix", f"""WITH {TRIALS}, m AS (SELECT method, n, avg(err) AS mean, stddev_pop(err) AS sd FROM trials GROUP BY GROUPING SETS ((method, n), (method)))
SELECT n, """ + ", ".join(f"round(max(mean) FILTER (method = '{m}'), 6) AS {m}_mean, round(max(sd) FILTER (method = '{m}'), 6) AS {m}_sd" for m in _METHODS) + " FROM m GROUP BY n")
def x10(spark, sf):
    t = X.mean_sd_table(trials(spark, sf), "method", "n", "err")
    return t.groupBy("n").pivot("method", _METHODS).agg(r6(F.max("mean"), "mean"), r6(F.max("sd"), "sd"))


@query("x11_related_genes", "SELECT DISTINCT l_returnflag AS method, p_partkey AS entrez, p_name AS gene FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0 AND p_size > 40")
def x11(spark, sf):
    weights = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("col_id"), F.col("l_discount").alias("w"))
    part = table(spark, sf, "part")
    names = part.select(F.col("p_partkey").alias("col_id"), F.col("p_partkey").alias("entrez"))
    related = part.filter("p_size > 40").select(F.col("p_partkey").alias("entrez"), F.col("p_name").alias("gene"))
    return X.related_genes(weights, names, related, ["method"])


@query("x12_weights_at_lambda", """WITH b AS (SELECT l_suppkey AS k, arg_min(l_linenumber, (t, l_linenumber)) AS lam FROM (SELECT l_suppkey, l_linenumber, round(sum(l_tax), 6) AS t FROM lineitem GROUP BY ALL) GROUP BY 1)
SELECT k, lam, l_partkey AS col_id, l_discount AS w FROM lineitem JOIN b ON k = l_suppkey AND lam = l_linenumber WHERE l_discount <> 0""")
def x12(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("lam"), F.col("l_partkey").alias("col_id"), F.col("l_discount").alias("w"), "l_tax")
    err = line.groupBy("k", "lam").agg(F.round(F.sum("l_tax"), 6).alias("t"))
    best = X.best_parameter(err, ["k"], ["lam"], "t", ["lam"])
    return X.weights_at(line.drop("l_tax"), best, ["k"], "lam")


@query("x13_run_time_scaling", """SELECT l_returnflag AS method, l_linenumber AS blocks, round(avg(l_quantity), 6) AS run_time, round(avg(l_discount + l_tax), 6) AS projection_time, round(avg(l_discount + l_tax) / avg(l_quantity), 6) AS share FROM lineitem GROUP BY 1, 2""")
def x13(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("blocks"), F.col("l_quantity").alias("run_time"), F.col("l_discount").alias("head_time"), F.col("l_tax").alias("tail_time"))
    return R.projection_share(runs, ["method", "blocks"]).select("method", "blocks", *[r6(F.col(c), c) for c in ("run_time", "projection_time", "share")])


@query("x15_sample_sizes", f"WITH {TRIALS}, s AS (SELECT method, count(DISTINCT user_id) AS s FROM trials GROUP BY 1) SELECT method, (15 + k) / 10 AS ratio, CAST(floor((15 + k) * s / 10) AS BIGINT) AS n FROM s, (SELECT unnest(range(21)) AS k)")
def x15(spark, sf):
    size = trials(spark, sf).groupBy("method").agg(F.count_distinct("user_id").alias("s"))
    grid = R.parameter_grid(size, {"k": list(range(15, 36))})
    return grid.select("method", (F.col("k") / 10).alias("ratio"), F.floor(F.col("k") * F.col("s") / 10).alias("n"))
