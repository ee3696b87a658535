"""Queries for sources, projections, joins, aggregates, windows, sorts, sets and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsetab.functions import scalar as S
from sparsetab.operators import ranking as W, relational as R
from sparsetab.plans.inputs import CELLS, EDGES, SCORED, TRIALS, TRIMMED, cells, graph_edges, matrix_rows, query, r6, response, scored, scratch, small_weights, table, trials
from sparsetab.sources import tables as ST, text as SX

# -- sources -----------------------------------------------------------------------

@query("s1_read_delimited", "SELECT p_partkey AS part, p_name AS name, p_size::DOUBLE AS size FROM part")
def s1(spark, sf):
    path = scratch(spark)
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.csv(path, sep="\t", quote=SX.QUOTE, header=True)
    got = SX.read_delimited(spark, path, ["part", "name", "size"], ["part", "size"])
    return got.select(F.col("part").cast("long").alias("part"), "name", "size")


@query("s2_read_edges", "SELECT l_partkey AS src, l_suppkey AS dst, 1.0::DOUBLE AS cost, count(*) AS n FROM lineitem GROUP BY 1, 2")
def s2(spark, sf):
    path = scratch(spark)
    table(spark, sf, "lineitem").select(F.col("l_partkey") + 1, F.col("l_suppkey") + 1).write.csv(path, sep="\t")
    return SX.read_edges(spark, path).groupBy("src", "dst", "cost").agg(F.count(F.lit(1)).alias("n"))


@query("s3_read_mapping", "SELECT p_size::BIGINT AS pathway_id, p_partkey AS entrez FROM part")
def s3(spark, sf):
    path = scratch(spark)
    table(spark, sf, "part").select("p_size", "p_partkey").write.csv(path, sep="\t")
    return SX.read_mapping(spark, path)


def _tagged(spark, sf):
    rows = matrix_rows(spark, sf).select("x", "y")
    edges = graph_edges(spark, sf).select("src", "dst", "cost")
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("value"))
    return rows, edges, nodes


@query("s4_read_tagged_lines", f"""WITH {CELLS}, {EDGES}
SELECT 'x_tr' AS tag, (SELECT count(*) FROM embeddings) AS n, round(sum(value) + (SELECT sum(y) FROM resp), 3) AS total FROM cells
UNION ALL SELECT 'E', count(*), round(sum(cost), 3) FROM edges
UNION ALL SELECT 'N', count(*), round(sum(p_retailprice), 3) FROM part""")
def s4(spark, sf):
    path = scratch(spark)
    SX.write_tagged(*_tagged(spark, sf), path)
    rows, edges, nodes = SX.read_tagged(spark, path)
    inner = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) + F.col("y")
    parts = [
        rows.agg(F.lit("x_tr").alias("tag"), F.count(F.lit(1)).alias("n"), F.round(F.sum(inner), 3).alias("total")),
        edges.agg(F.lit("E").alias("tag"), F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 3).alias("total")),
        nodes.agg(F.lit("N").alias("tag"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s5_tagged_lines", f"""WITH {EDGES} SELECT 'x_tr ' || array_to_string([printf('%.8f', CAST(x AS DOUBLE)) FOR x IN embedding], ' ') || CASE WHEN label < 5 THEN ' 1.0' ELSE ' -1.0' END AS value FROM embeddings
UNION ALL SELECT 'P ' || (SELECT count(*) FROM embeddings) || ' ' || (SELECT max(len(embedding)) FROM embeddings) || ' ' || (SELECT count(*) FROM edges) AS value
UNION ALL SELECT printf('E %d %d %.8f', src, dst, cost) FROM edges
UNION ALL SELECT printf('N %d %.8f', p_partkey, p_retailprice) FROM part""")
def s5(spark, sf):
    rows, edges, nodes = _tagged(spark, sf)
    return SX.tagged_lines(rows, edges, nodes)


@query("s6_network_lines", """SELECT DISTINCT (2 * l_partkey)::VARCHAR AS value FROM lineitem
UNION ALL SELECT DISTINCT (2 * l_partkey)::VARCHAR || ' pp ' || (2 * l_suppkey + 1)::VARCHAR FROM lineitem""")
def s6(spark, sf):
    path = scratch(spark)
    line = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    SX.write_network(line.select(F.col("src").alias("node")).distinct(), line.distinct(), path)
    return spark.read.text(path)


@query("s7_sample_blocks", f"""WITH {CELLS}, m AS (SELECT row_id, label * 16 + col_id // 4 AS sample_id, col_id % 4 AS k, value FROM cells JOIN embeddings ON vec_id = row_id)
SELECT CAST(sample_id AS INTEGER) AS sample_id, count(*) // 4 AS n, round(sum(value) FILTER (k = 0), 5) AS m0, round(sum(value) FILTER (k = 1), 5) AS m1,
round(sum(value) FILTER (k = 2), 5) AS m2, round(sum(value) FILTER (k = 3), 5) AS m3 FROM m GROUP BY 1""")
def s7(spark, sf):
    path = scratch(spark)
    lines = table(spark, sf, "embeddings").select(
        F.col("label").alias("block"),
        F.concat_ws("\t", F.concat(F.lit("sub"), F.col("vec_id").cast("string")), F.lit("gene"), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), "\t")).alias("value"))
    lines.write.partitionBy("block").text(path)
    offsets = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), (F.col("block") * 16).alias("offset")).distinct()
    names = ["m0", "m1", "m2", "m3"]
    long = SX.read_sample_blocks(spark, path, offsets, names)
    return long.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(m), 5).alias(m) for m in names])


@query("s8_results_round_trip", f"WITH {TRIALS} SELECT method, n, count(*) AS trials, round(sum(err), 4) AS err FROM trials GROUP BY 1, 2")
def s8(spark, sf):
    path = scratch(spark)
    ST.write_results(trials(spark, sf), path, ["method"])
    return ST.read_results(spark, path).groupBy("method", "n").agg(F.count(F.lit(1)).alias("trials"), F.round(F.sum("err"), 4).alias("err"))


@query("s9_method_tables", f"WITH {TRIALS} SELECT trial, n, err FROM trials WHERE method = 'click'")
def s9(spark, sf):
    path = scratch(spark)
    ST.write_results(trials(spark, sf), path, ["method"])
    return ST.read_results(spark, path, "method = 'click'").select("trial", "n", "err")


# -- projections and filters ---------------------------------------------------------

@query("p1_prize", f"WITH {CELLS} SELECT row_id, col_id, round(value * value, 6) AS prize FROM cells")
def p1(spark, sf):
    return cells(spark, sf).select("row_id", "col_id", r6(S.prize(F.col("value")), "prize"))


@query("p2_clamp_high", "SELECT p_brand, least(max(p_size) * 4, count(*) - 1) AS s_high FROM part GROUP BY p_brand")
def p2(spark, sf):
    sizes = table(spark, sf, "part").groupBy("p_brand").agg(F.max("p_size").alias("m"), F.count(F.lit(1)).alias("p"))
    return sizes.select("p_brand", S.clamp_high(F.col("m") * 4, F.col("p")).alias("s_high"))


@query("p3_drop_self_loops", "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey")
def p3(spark, sf):
    return R.drop_self_loops(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("p4_constant_columns", """WITH c AS (SELECT p_size AS col_id, (CASE WHEN p_type = 'ECONOMY' AND p_size > 25 THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM part)
SELECT col_id FROM c GROUP BY col_id HAVING avg(value) = 0 AND stddev_pop(value) = 0""")
def p4(spark, sf):
    value = F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") > 25), 1.0).otherwise(0.0)
    return R.constant_columns(table(spark, sf, "part").select(F.col("p_size").alias("col_id"), value.alias("value")))


@query("p5_large_columns", f"WITH {CELLS} SELECT col_id, round(max(abs(value)), 6) AS peak FROM cells GROUP BY col_id HAVING max(abs(value)) > 0.2")
def p5(spark, sf):
    return R.large_columns(cells(spark, sf)).select("col_id", r6(F.col("peak"), "peak"))


@query("p6_mean_flag", "SELECT l_partkey, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1 HAVING avg(l_discount) < 0.045")
def p6(spark, sf):
    return R.rows_below_mean(table(spark, sf, "lineitem"), "l_partkey", "l_discount", 0.045).select("l_partkey", r6(F.col("mean"), "mean"))


@query("p7_recovered", f"WITH {TRIALS} SELECT trial, CASE WHEN err <= 20 THEN 1 ELSE 0 END AS ok, CASE WHEN err <= 20 AND err <> 0 THEN 1 ELSE 0 END AS strict FROM trials")
def p7(spark, sf):
    return trials(spark, sf).select("trial", S.recovered(F.col("err"), 20.0).alias("ok"), S.recovered(F.col("err"), 20.0, True).alias("strict"))


@query("p8_guarded_prizes", "SELECT o_orderkey, o_totalprice AS prize FROM orders")
def p8(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.non_negative(F.col("o_totalprice")).alias("prize"))


@query("p9_labels", f"WITH {CELLS} SELECT row_id, col_id, CASE WHEN value > 0 THEN 1 ELSE -1 END AS cls, CASE WHEN value < 0.5 THEN -1 ELSE 1 END AS pred FROM cells")
def p9(spark, sf):
    return cells(spark, sf).select("row_id", "col_id", S.sign_label(F.col("value")).alias("cls"), S.predicted_label(F.col("value")).alias("pred"))


# -- joins -----------------------------------------------------------------------------

@query("j1_id_to_attribute", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def j1(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    supp = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return line.join(part, "l_partkey").join(supp, "l_suppkey").select("l_orderkey", "l_linenumber", "p_name", "s_name")


_SMALL_NODES = """nodes AS (SELECT 2 * p_partkey AS node FROM part WHERE p_size <= 25 UNION ALL SELECT 2 * s_suppkey + 1 FROM supplier WHERE s_acctbal > 0)"""


def _small_nodes(spark, sf):
    part = table(spark, sf, "part").filter("p_size <= 25").select((F.col("p_partkey") * 2).alias("node"))
    return part.unionByName(table(spark, sf, "supplier").filter("s_acctbal > 0").select((F.col("s_suppkey") * 2 + 1).alias("node")))


@query("j2_edges_within", f"WITH {EDGES}, {_SMALL_NODES} SELECT problem_id, src, dst FROM edges WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)")
def j2(spark, sf):
    return R.edges_within(graph_edges(spark, sf), _small_nodes(spark, sf)).select("problem_id", "src", "dst")


@query("j3_measured_pathways", "SELECT p_brand, p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def j3(spark, sf):
    measured = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_brand", "p_partkey").join(measured, "p_partkey", "left_semi")


@query("j4_unmapped", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("j5_first_match", """WITH names AS (SELECT p_partkey AS entrez, unnest(string_split(p_name, ' ')) AS name, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part WHERE p_size <> 10),
known AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part WHERE p_type = 'PROMO'
  UNION SELECT DISTINCT string_split(p_name, ' ')[2] FROM part WHERE p_brand = 'Brand#1'),
best AS (SELECT entrez, arg_min(n.name, pos) FILTER (k.name IS NOT NULL) AS name FROM names n LEFT JOIN known k ON k.name = n.name GROUP BY entrez)
SELECT p_partkey AS entrez, CASE WHEN b.entrez IS NULL THEN 'No_Entrez_Found' WHEN b.name IS NULL THEN 'No_Gene_Found' ELSE b.name END AS name FROM part LEFT JOIN best b ON b.entrez = p_partkey""")
def j5(spark, sf):
    part = table(spark, sf, "part")
    words = S.split_words(F.col("p_name"))
    names = part.filter("p_size <> 10").select(F.col("p_partkey").alias("entrez"), F.posexplode(words).alias("pos", "name"))
    known = part.filter("p_type = 'PROMO'").select(F.get(words, F.lit(0)).alias("name")).union(part.filter("p_brand = 'Brand#1'").select(F.get(words, F.lit(1))))
    return R.first_match(part.select(F.col("p_partkey").alias("entrez")), names, known)


@query("j6_parameter_grid", """SELECT p_brand, s, blocks, lam, count(*) AS parts FROM part, (SELECT unnest([10, 15, 20]) AS s) a, (SELECT unnest([1, 2]) AS blocks) b, (SELECT unnest([0.001::DOUBLE, 0.0001::DOUBLE]) AS lam) c GROUP BY ALL""")
def j6(spark, sf):
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))
    return R.parameter_grid(brands, {"s": [10, 15, 20], "blocks": [1, 2], "lam": [1e-3, 1e-4]})


@query("j7_reindex", """WITH e AS (SELECT DISTINCT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem),
ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS new_id FROM (SELECT src AS node FROM e UNION SELECT dst FROM e))
SELECT a.new_id AS src, b.new_id AS dst FROM e JOIN ids a ON a.node = src JOIN ids b ON b.node = dst""")
def j7(spark, sf):
    edges = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return R.reindex_edges(edges, W.dense_ids(nodes, "node")).select("src", "dst")


@query("j8_restrict_groups", """WITH kept AS (SELECT p_partkey AS col_id, row_number() OVER (ORDER BY p_partkey) - 1 AS new_col FROM part WHERE p_size <= 25)
SELECT p_brand AS group_id, col_id, new_col FROM part JOIN kept ON col_id = p_partkey""")
def j8(spark, sf):
    part = table(spark, sf, "part")
    kept = W.dense_ids(part.filter("p_size <= 25").select(F.col("p_partkey").alias("col_id")), "col_id", "new_col")
    return R.restrict_groups(part.select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("col_id")), kept)


@query("j9_symmetric", "WITH e AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e")
def j9(spark, sf):
    return R.symmetric(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("j10_merge_results", f"""WITH {TRIALS}, a AS (SELECT user_id, method, round(avg(err), 6) AS low FROM trials WHERE err < 50 GROUP BY 1, 2),
b AS (SELECT user_id, method, round(avg(err), 6) AS high FROM trials WHERE err >= 50 GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.method, b.method) AS method, low, high FROM a FULL JOIN b ON a.user_id = b.user_id AND a.method = b.method""")
def j10(spark, sf):
    t = trials(spark, sf)
    low = t.filter("err < 50").groupBy("user_id", "method").agg(r6(F.avg("err"), "low"))
    high = t.filter("err >= 50").groupBy("user_id", "method").agg(r6(F.avg("err"), "high"))
    return R.merge_result_tables(low, high, ["user_id", "method"])


# -- aggregates ---------------------------------------------------------------------------

@query("a1_norms", f"""WITH {CELLS} SELECT row_id, round(sqrt(sum((value - w) * (value - w))), 6) AS norm
FROM (SELECT row_id, value, CASE WHEN col_id % 2 = 0 THEN 0.01 ELSE -0.01 END AS w FROM cells) GROUP BY row_id""")
def a1(spark, sf):
    x = cells(spark, sf)
    return R.l2_distance(x, x.select("row_id", "col_id", small_weights("value")), ["row_id"], "col_id", "value").select("row_id", r6(F.col("norm"), "norm"))


@query("a2_mean_sd", f"WITH {TRIALS} SELECT method, n, round(avg(err), 6) AS mean, round(stddev_pop(err), 6) AS sd, count(*) AS n_trials FROM trials GROUP BY GROUPING SETS ((method, n), (method))")
def a2(spark, sf):
    from sparsetab.operators.experiments import mean_sd_table

    t = mean_sd_table(trials(spark, sf), "method", "n", "err")
    return t.select("method", "n", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), "n_trials")


@query("a3_subfold_sums", """SELECT l_returnflag AS method, l_linenumber AS s, round(sum(l_discount), 4) AS acc, round(sum(l_tax), 4) AS bacc FROM lineitem GROUP BY 1, 2""")
def a3(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("s")).agg(
        F.round(F.sum("l_discount"), 4).alias("acc"), F.round(F.sum("l_tax"), 4).alias("bacc"))


@query("a4_sign_counts", f"""WITH {CELLS}, ins AS (SELECT vec_id AS row_id FROM embeddings WHERE label < 5)
SELECT col_id, count(*) FILTER (value <> 0) AS nonzero, count(*) FILTER (i.row_id IS NOT NULL AND value < 0) AS nega_in, count(*) FILTER (i.row_id IS NULL AND value < 0) AS nega_out,
count(*) FILTER (i.row_id IS NOT NULL AND value > 0) AS posi_in, count(*) FILTER (i.row_id IS NULL AND value > 0) AS posi_out FROM cells c LEFT JOIN ins i ON i.row_id = c.row_id GROUP BY col_id""")
def a4(spark, sf):
    w = cells(spark, sf).select("col_id", F.col("row_id").alias("node"), F.col("value").alias("w"))
    inside = response(spark, sf).filter("y > 0").select(F.col("row_id").alias("node"))
    return R.sign_counts(w, inside, ["col_id"])


@query("a5_found_union", "SELECT DISTINCT l_returnflag AS method, l_partkey AS gene FROM lineitem WHERE l_quantity > 25")
def a5(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity > 25").select(F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("gene")).distinct()


@query("a6_run_time_share", """SELECT l_returnflag AS method, round(avg(l_extendedprice), 4) AS run_time, round(avg(l_discount + l_tax), 6) AS projection_time,
round(avg(l_discount + l_tax) / avg(l_extendedprice) * 1000, 6) AS share FROM lineitem GROUP BY 1""")
def a6(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_extendedprice").alias("run_time"), F.col("l_discount").alias("head_time"), F.col("l_tax").alias("tail_time"))
    return R.projection_share(runs, ["method"]).select("method", F.round("run_time", 4).alias("run_time"), r6(F.col("projection_time"), "projection_time"), r6(F.col("share") * 1000, "share"))


@query("a7_prize_range", f"WITH {CELLS} SELECT col_id, round(greatest(min(value) FILTER (value > 0), 1e-6), 6) AS min_prize, round(sum(value), 6) AS total FROM cells GROUP BY col_id")
def a7(spark, sf):
    return R.prize_range(cells(spark, sf).withColumnRenamed("value", "prize"), ["col_id"]).select("col_id", r6(F.col("min_prize"), "min_prize"), r6(F.col("total"), "total"))


@query("a9_class_weights", "SELECT toxic AS k, round(count(*) FILTER (quality = 0) / count(*), 6) AS cp, round(count(*) FILTER (quality = 1) / count(*), 6) AS cn, count(*) AS n FROM labels GROUP BY toxic")
def a9(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("toxic").alias("k"), S.sign_label(F.col("quality")).alias("y"))
    return R.class_weights(rows, ["k"]).select("k", r6(F.col("cp"), "cp"), r6(F.col("cn"), "cn"), "n")


# -- windows ---------------------------------------------------------------------------------

@query("w1_dense_ids", "SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS new_id FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def w1(spark, sf):
    return W.dense_ids(table(spark, sf, "lineitem"), "l_partkey")


@query("w2_symmetric_trim", f"WITH {TRIMMED} SELECT method, n, err, count(*) AS kept FROM kept GROUP BY 1, 2, 3")
def w2(spark, sf):
    return W.trimmed_counts(trials(spark, sf), ["method", "n"], "err", 0.05)


_TRACE = """trace AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, value AS err FROM events)"""


def _trace(spark, sf):
    return W.ranked(table(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("err")), ["user_id"], [F.col("event_id")], "step", 0)


@query("w3_padded_trace", f"""WITH {_TRACE}, grid AS (SELECT user_id, unnest(range(80)) AS step FROM (SELECT DISTINCT user_id FROM events))
SELECT g.user_id, g.step, last_value(t.err IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.step) AS err FROM grid g LEFT JOIN trace t ON t.user_id = g.user_id AND t.step = g.step""")
def w3(spark, sf):
    return W.padded_trace(_trace(spark, sf).select("user_id", "step", "err"), ["user_id"], "step", "err", 80)


@query("w4_mean_ranks", f"""WITH {SCORED}, r AS (SELECT score, rank() OVER (ORDER BY score) AS rk FROM scored) SELECT score, count(*) AS cnt, min(rk) + (count(*) - 1) / 2 AS mean_rank FROM r GROUP BY score""")
def w4(spark, sf):
    return W.mean_ranks(scored(spark, sf), ["k"], "score").select("score", "cnt", "mean_rank")


@query("w5_kmers", """WITH o AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part),
w AS (SELECT p_brand, pos AS start, list(p_partkey) OVER (PARTITION BY p_brand ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM o)
SELECT p_brand, start, m[1] AS a, m[2] AS b, m[3] AS c FROM w WHERE len(m) = 3""")
def w5(spark, sf):
    chain = W.ranked(table(spark, sf, "part").select("p_brand", "p_partkey"), ["p_brand"], [F.col("p_partkey")], "pos", 0)
    found = W.kmers(chain, ["p_brand"], "pos", "p_partkey", 3)
    return found.select("p_brand", "start", F.col("members")[0].alias("a"), F.col("members")[1].alias("b"), F.col("members")[2].alias("c"))


@query("w6_first_wins", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def w6(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return W.first_wins(line, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey")


# -- sorts and top-k -------------------------------------------------------------------------

@query("t1_hard_threshold", f"""WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, col_id) AS rn FROM cells)
SELECT row_id, col_id, round(CASE WHEN rn <= 5 THEN value ELSE 0 END, 6) AS value FROM r""")
def t1(spark, sf):
    return W.hard_threshold(cells(spark, sf), ["row_id"], "value", "col_id", 5, zero_rest=True).select("row_id", "col_id", r6(F.col("value"), "value"))


@query("t2_top_magnitude", f"WITH {CELLS} SELECT row_id, col_id, round(value, 6) AS value FROM cells QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, col_id) <= 3")
def t2(spark, sf):
    return W.top_k(cells(spark, sf), ["row_id"], W.by_magnitude("value", "col_id"), 3).select("row_id", "col_id", r6(F.col("value"), "value"))


@query("t3_argsort", """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS up, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS down FROM orders""")
def t3(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    up = W.ranked(o, [], [F.col("o_totalprice"), F.col("o_orderkey")], "up", 0)
    return W.ranked(up, [], [F.col("o_totalprice").desc(), F.col("o_orderkey")], "down", 0).select("o_orderkey", "up", "down")


@query("t4_argsort_magnitude", "SELECT c_custkey, row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) - 1 AS pos FROM customer")
def t4(spark, sf):
    return W.ranked(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [], W.by_magnitude("c_acctbal", "c_custkey"), "pos", 0).select("c_custkey", "pos")


@query("t5_two_key_sort", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey) - 1 AS pos FROM part")
def t5(spark, sf):
    return W.ranked(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), [], [F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")], "pos", 0).select("p_partkey", "pos")


@query("t7_best_groups", "SELECT p_type, p_brand, round(sum(p_retailprice), 2) AS score FROM part GROUP BY p_type, p_brand QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY round(sum(p_retailprice), 2) DESC, p_brand) <= 4")
def t7(spark, sf):
    score = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("score"))
    return W.top_k(score, ["p_type"], [F.col("score").desc(), F.col("p_brand")], 4)


# -- sets --------------------------------------------------------------------------------------

def _entries(spark, sf, flag):
    """Entries of a support, repeats included."""
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("col_id"))


@query("u1_union", "SELECT DISTINCT l_suppkey AS k, l_partkey AS col_id FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def u1(spark, sf):
    return R.union_supports(_entries(spark, sf, "R"), _entries(spark, sf, "A"), rows=table(spark, sf, "lineitem").count())


@query("u2_intersection", "SELECT l_suppkey AS k, l_partkey AS col_id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def u2(spark, sf):
    return _entries(spark, sf, "R").distinct().intersect(_entries(spark, sf, "A").distinct())


@query("u3_same_support", """WITH a AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS i FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS i FROM lineitem WHERE l_returnflag = 'A')
SELECT coalesce(a.k, b.k) AS k, bool_and(a.k IS NOT NULL AND b.k IS NOT NULL) AS equal FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i GROUP BY 1""")
def u3(spark, sf):
    one, two = (_entries(spark, sf, flag).select(F.col("col_id").alias("k"), F.col("k").alias("i")) for flag in "RA")
    return R.same_support(one, two, ["k"], "i", rows=table(spark, sf, "lineitem").count())


@query("u4_merge_names", """SELECT p_partkey AS entrez, unnest(string_split(p_name, ' ')) AS name, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos, 0 AS source FROM part WHERE p_type = 'PROMO'
UNION ALL SELECT p_partkey, p_brand, 0, 1 FROM part""")
def u4(spark, sf):
    part = table(spark, sf, "part")
    first = part.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("entrez"), F.posexplode(S.split_words(F.col("p_name"))).alias("pos", "name"))
    second = part.select(F.col("p_partkey").alias("entrez"), F.col("p_brand").alias("name"), F.lit(0).alias("pos"))
    return R.merge_name_lists(first, second).select("entrez", "name", F.col("pos").cast("long").alias("pos"), "source")


@query("u5_inactive_groups", "SELECT DISTINCT p_brand, p_type FROM part EXCEPT SELECT p_brand, p_type FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 50 AND l_discount >= 0.1")
def u5(spark, sf):
    part = table(spark, sf, "part")
    sold = table(spark, sf, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1").select(F.col("l_partkey").alias("p_partkey"))
    active = part.join(sold, "p_partkey", "left_semi").select("p_brand", "p_type")
    return part.select("p_brand", "p_type").distinct().join(active, ["p_brand", "p_type"], "left_anti")


# -- scalars -------------------------------------------------------------------------------------

@query("f1_sigmoid", "SELECT c_custkey, round(CASE WHEN x > 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 6) AS prob FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")
def f1(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", r6(S.sigmoid(F.col("c_acctbal") / 1000), "prob"))


@query("f2_log_sigmoid", "SELECT c_custkey, round(CASE WHEN x > 0 THEN -ln(1 + exp(-x)) ELSE x - ln(1 + exp(x)) END, 6) AS v FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")
def f2(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", r6(S.log_sigmoid(F.col("c_acctbal") / 1000), "v"))


@query("f3_split_values", "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token <> '' GROUP BY token")
def f3(spark, sf):
    return table(spark, sf, "part").select(F.explode(S.split_words(F.col("p_name"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("f4_log_curve", f"WITH {TRIMMED} SELECT method, n, round(log10(avg(err)), 6) AS v FROM kept GROUP BY 1, 2")
def f4(spark, sf):
    kept = W.trimmed_counts(trials(spark, sf), ["method", "n"], "err", 0.05)
    return kept.groupBy("method", "n").agg(r6(F.log10(F.sum(F.col("err") * F.col("kept")) / F.sum("kept")), "v"))


@query("f5_harmonic_mean", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_discount + l_tax > 0 THEN 2 * l_discount * l_tax / (l_discount + l_tax) ELSE 0 END, 6) AS h FROM lineitem")
def f5(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(S.harmonic_mean(F.col("l_discount"), F.col("l_tax")), "h"))


@query("f6_cell_node", f"WITH {CELLS} SELECT row_id * 64 + col_id AS node, row_id AS r, col_id::BIGINT AS c FROM cells")
def f6(spark, sf):
    at = cells(spark, sf).select(S.cell_node(F.col("row_id"), F.col("col_id"), 64).alias("node"))
    r, c = S.node_cell(F.col("node"), 64)
    return at.select("node", r.alias("r"), c.cast("long").alias("c"))


@query("f7_mean_sd_text", f"WITH {TRIALS} SELECT method, printf('%.3f ± %.3f', avg(err), stddev_pop(err)) AS cell FROM trials GROUP BY method")
def f7(spark, sf):
    return trials(spark, sf).groupBy("method").agg(S.mean_sd_text(F.avg("err"), F.stddev_pop("err")).alias("cell"))


@query("f8_lambda_grid", f"""WITH {CELLS}, m AS (SELECT max(abs(s)) AS top FROM (SELECT col_id, sum(value * y) AS s FROM cells JOIN resp USING (row_id) GROUP BY col_id))
SELECT CAST(k AS INTEGER) AS k, round(top * pow(2, -k * 0.1), 6) AS lam FROM m, (SELECT unnest(range(121)) AS k)""")
def f8(spark, sf):
    from sparsetab.operators.matrix import t_matvec

    top = t_matvec(cells(spark, sf), response(spark, sf).withColumnRenamed("y", "v")).agg(F.max(F.abs("total")).alias("top"))
    return top.select(F.posexplode(S.power_grid(0.0, -0.1, -12.0, F.col("top"))).alias("k", "lam")).select("k", r6(F.col("lam"), "lam"))
