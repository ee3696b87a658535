"""Scalars, ranks under skew, splits and files."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparsetab.functions import scalar as S
from sparsetab.operators import evaluate as E, ranking as W, relational as R
from sparsetab.sources import tables as ST, text as SX


def test_sigmoid_extremes(spark):
    got = spark.createDataFrame([(v,) for v in (-1e5, -10.0, -1.0, 0.0, 1.0, 10.0, 1e5)], "x double").select(S.sigmoid(F.col("x")), S.log_sigmoid(F.col("x"))).collect()
    assert [round(r[0], 8) for r in got] == [0.0, 4.54e-05, 0.26894142, 0.5, 0.73105858, 0.9999546, 1.0]
    assert got[0][1] == -1e5 and got[-1][1] == 0.0


def test_prediction(spark):
    x = [([0.1, 0.2],), ([1.0, 1.0],), ([0.0, 0.0],), ([-1.0, -1.0],)]
    df = spark.createDataFrame(x, "x array<double>").withColumn("pred", S.dot(F.col("x"), F.array(F.lit(-0.1), F.lit(1.0))))
    assert [r.label for r in E.logistic_predict(df).collect()] == [1, 1, 1, -1]


def test_negative_prize_fails(spark):
    with pytest.raises(Exception, match="prizes must not be negative"):
        spark.createDataFrame([(-1.0,)], "p double").select(S.non_negative(F.col("p"))).collect()


def test_sorts(spark):
    x = [0.2, -0.3, -0.1, 0.4, 0.1, 0.0]
    df = spark.createDataFrame(list(enumerate(x)), "i long, v double")
    up = W.ranked(df, [], [F.col("v"), F.col("i")], "pos", 0).orderBy("pos").collect()
    assert [r.i for r in up] == [1, 2, 5, 4, 0, 3]
    top = W.top_k(df.withColumn("k", F.lit(0)), ["k"], W.by_magnitude("v", "i"), 3).collect()
    assert {r.i for r in top} == {3, 1, 0}


def test_ranks_with_a_hot_key_and_ties(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.randrange(6), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, i long").repartition(7)
    got = {r.i: r.rn for r in W.ranked(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    for key in {k for k, _, _ in data}:
        mine = sorted((v, i) for k, v, i in data if k == key)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in W.running_totals(counts, ["k"], "v", ["n"]).collect():
        assert r.n_before == sum(1 for k, v, _ in data if k == r.k and v < r.v)


def test_top_k_beyond_the_group_limit(spark):
    """A large k on one key takes ranks, and no window that covers the key."""
    df = spark.range(8000).select(F.lit("a").alias("k"), F.pmod(F.col("id") * 7919, F.lit(8000)).alias("v"))
    top = W.top_k(df, ["k"], [F.col("v").desc()], 5000)
    assert sorted(r.v for r in top.collect()) == list(range(3000, 8000))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(_run" in plan


def test_trim_keeps_multiplicities(spark):
    values = [0.0] * 30 + [1.0] * 5 + [2.0, 3.0, 4.0, 5.0, 9.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    kept = {r.v: r.kept for r in W.trimmed_counts(df, ["k"], "v", 0.05).collect()}
    assert kept == {0.0: 28, 1.0: 5, 2.0: 1, 3.0: 1, 4.0: 1}


def test_auc_counts_pairs(spark):
    rng = random.Random(9)
    data = [(0, rng.choice([-1, 1]), float(rng.randrange(12))) for _ in range(300)]
    pos = [s for _, y, s in data if y > 0]
    neg = [s for _, y, s in data if y < 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert E.auc(spark.createDataFrame(data, "k int, y int, score double"), ["k"]).first().auc == pytest.approx(want)


def test_tagged_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([([0.5, -1.25], 1.0), ([2.0, 0.0], -1.0)], "x array<double>, y double")
    edges = spark.createDataFrame([(0, 1, 1.5)], "src long, dst long, cost double")
    nodes = spark.createDataFrame([(0, 0.25), (1, 4.0)], "node long, value double")
    SX.write_tagged(rows, edges, nodes, str(tmp_path / "t"))
    got = SX.read_tagged(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, got[0].collect())) == sorted(map(tuple, rows.collect()))
    assert got[1].collect() == edges.collect()
    assert sorted(map(tuple, got[2].collect())) == sorted(map(tuple, nodes.collect()))


def test_headers_are_told_by_content(spark, tmp_path):
    (tmp_path / "n.tab").write_text("some\theader\nEntry\tCross\nP1\t12,34\tA B  C\nP2\t7\tD\n")
    names = SX.read_gene_names(spark, str(tmp_path / "n.tab"), "ids", "names", ["entry", "ids", "names"])
    assert sorted((r.entrez, r.pos, r.name) for r in names.collect()) == [(7, 0, "D"), (12, 0, "A"), (12, 1, "B"), (12, 2, "C"), (34, 0, "A"), (34, 1, "B"), (34, 2, "C")]


def test_results_are_pruned_by_partition(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "exp string, trial int, err double")
    ST.write_results(df, str(tmp_path / "r"))
    assert ST.read_results(spark, str(tmp_path / "r"), "exp = 'a' and trial = 1").select("err").collect()[0].err == 2.0


def test_log_sigmoid_matches_log(spark):
    for v in (-3.0, 0.5):
        assert spark.range(1).select(S.log_sigmoid(F.lit(v))).first()[0] == pytest.approx(math.log(1 / (1 + math.exp(-v))))


def test_numbers_in_text_are_rounded_as_c_does(spark):
    values = [0.001953125, -0.001953125, 0.005859375, -0.0, -1e-12, 0.123456785, 0.999999999, 123456789.1, 2.5, 1e17]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", S.fixed(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["%.8f" % v for v in values]
    rows = spark.createDataFrame([([0.001953125], 1.0)], "x array<double>, y double")
    edges = spark.createDataFrame([(1, 2, 0.001953125)], "src long, dst long, cost double")
    nodes = spark.createDataFrame([(1, 0.001953125)], "node long, value double")
    assert {r.value for r in SX.tagged_lines(rows, edges, nodes).collect()} == {"P 1 1 1", "x_tr 0.00195312 1.0", "E 1 2 0.00195312", "N 1 0.00195312"}


def test_mean_at_the_limit_is_not_below_it(spark):
    data = [(1, v) for v in (0.04, 0.04, 0.04, 0.05, 0.05, 0.05)] + [(2, 0.02), (2, 0.03)] + [(3, 1e30)] + [(4, None), (5, 0.01), (5, None)]
    below = R.rows_below_mean(spark.createDataFrame(data, "k int, v double").coalesce(1), "k", "v", 0.045).collect()
    assert {r.k: r["mean"] for r in below} == {2: 0.025, 5: 0.01}


def test_supports_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    one, two = (spark.range(n).select(F.col("id") % 1000, F.col("id") % 7).toDF("k", "i") for n in (7000, 9000))
    got = R.union_supports(one, two, rows=16000).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r[:-1] for r in got) == sorted((k, i) for k in range(1000) for i in range(7))
    assert max(Counter(r.task for r in got).values()) < 200


@pytest.mark.parametrize("rows", [0, 6, 6000])
def test_same_support_holds_entries_once(spark, monkeypatch, rows):
    monkeypatch.setattr(R, "TASK_ROWS", 1000)
    one = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (3, 5), (3, 5), (None, 1), (5, None)], "k long, i long")
    two = spark.createDataFrame([(1, 2), (1, 1), (2, 2), (2, 1), (4, 5), (4, 5), (None, 1), (5, None)], "k long, i long")
    got = R.same_support(one, two, ["k"], "i", rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("HashAggregate(") == 4  # entries, then keys
    assert {r.k: r.equal for r in got.collect()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: True}
