"""Searches over lambda against exhaustive search, and large problems against ones that fit a task."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsetab import lineage
from sparsetab.operators import contraction as C, forest as FO, graph as G, search, trees

E_SCHEMA = "problem_id long, src long, dst long, cost double"
N_SCHEMA = "problem_id long, node long, prize double"


def subtrees(n, edges):
    """Nodes and cost of every connected part of a forest."""
    found = [({v}, 0.0) for v in range(n)]
    for size in range(1, len(edges) + 1):
        for chosen in itertools.combinations(edges, size):
            seen, grown = {chosen[0][0]}, True
            while grown:
                more = {x for u, v, _ in chosen if (u in seen) != (v in seen) for x in (u, v)} - seen
                seen, grown = seen | more, bool(more)
            if len(seen) == size + 1:
                found.append((seen, sum(c for _, _, c in chosen)))
    return found


def hull(n, prizes, edges):
    """Best subtrees by lambda: ``(lam, nodes, cost, prize)`` at 0, and just beyond each value where the best changes."""
    parts = [(s, c, sum(prizes[v] for v in s)) for s, c in subtrees(n, edges)]
    lam, here = 0.0, max(parts, key=lambda t: (t[2], -t[1], -len(t[0])))
    out = [(lam, *here)]
    while True:
        ahead = [((here[2] - p) / (here[1] - c), -(here[1] - c), s, c, p) for s, c, p in parts if c < here[1] - 1e-12]
        ahead = [t for t in ahead if t[0] >= lam - 1e-12]
        if not ahead:
            return out
        lam = min(t[0] for t in ahead)
        best = min((t for t in ahead if t[0] <= lam + 1e-9), key=lambda t: (t[3], -t[4], len(t[2])))
        here = (best[2], best[3], best[4])
        out.append((lam, *here))


def random_trees(seed, count, cost):
    rng = random.Random(seed)
    cases = {}
    for k in range(count):
        n = rng.randint(2, 9)
        edges = [(rng.randrange(v), v, cost(rng)) for v in range(1, n) if rng.random() < 0.93]
        cases[k] = (n, [rng.choice([0.0, 0.4, 1.3, 2.9, 4.7]) * rng.uniform(0.9, 1.1) for _ in range(n)], edges)
    return cases


def frames(spark, cases):
    edges = [(k, u, v, c) for k, (_, _, es) in cases.items() for u, v, c in es]
    nodes = [(k, v, p) for k, (_, ps, _) in cases.items() for v, p in enumerate(ps)]
    return spark.createDataFrame(edges, E_SCHEMA).repartition(3), spark.createDataFrame(nodes, N_SCHEMA)


def rows_by_problem(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.problem_id, []).append(r)
    return found


@pytest.mark.parametrize("cost", [lambda rng: 1.0, lambda rng: rng.choice([0.3, 1.0, 2.2, 3.1]) * rng.uniform(0.9, 1.1)], ids=["equal", "any"])
@pytest.mark.parametrize("low, high", [(2, 2), (3, 4), (5, 5)])
def test_size_band_is_exhaustive(spark, low, high, cost):
    """In the band exactly where some lambda is; what is returned is best for its lambda."""
    cases = random_trees(low * 10 + high, 40, cost)
    got = rows_by_problem(FO.size_band(*frames(spark, cases), low, high))
    for k, (n, prizes, edges) in cases.items():
        top = min(high, max(n - 1, 1))
        steps = hull(n, prizes, edges)
        reachable = any(low <= len(s) <= top for _, s, _, _ in steps)
        nodes = {r.node for r in got[k]}
        assert {(r.in_band, r.converged) for r in got[k]} == {(reachable, True)}, (k, steps)
        assert not reachable or low <= len(nodes) <= top
        assert any(nodes == s for _, s, _, _ in steps), (k, nodes, steps)


def test_cost_searches_are_exhaustive(spark):
    cases = random_trees(3, 40, lambda rng: rng.choice([0.3, 1.0, 2.2]) * rng.uniform(0.9, 1.1))
    edges, nodes = frames(spark, cases)
    budget, nu = 1.1, 3.0
    head, tail = rows_by_problem(FO.cost_head(edges, nodes, budget)), rows_by_problem(FO.cost_tail(edges, nodes, budget, nu))
    for k, (n, prizes, es) in cases.items():
        steps = hull(n, prizes, es)
        within = next(p for _, _, c, p in steps if c <= 2 * budget)  # the dearest support within the bound
        assert all(r.converged for r in head[k])
        assert sum(prizes[r.node] for r in head[k]) >= within - 1e-9
        spent = min((c for s, c in subtrees(n, es) if s == {r.node for r in head[k]}), default=0.0)
        assert spent <= 2 * budget + 1e-9
        whole = steps[0][2] <= 2 * budget and steps[0][3] >= sum(prizes) - 1e-9
        hit = whole or any(2 * budget <= c <= nu * budget for _, _, c, _ in steps)
        assert {(r.in_band, r.converged) for r in tail[k]} == {(hit, True)}
        cost = next(c for s, c in subtrees(n, es) if s == {r.node for r in tail[k]})
        assert whole or not hit or 2 * budget - 1e-9 <= cost <= nu * budget + 1e-9


def test_rules_take_few_solves():
    """A long path with a prize on every node: a handful of solves, not one for each support."""
    rng = random.Random(8)
    n = 3000
    prizes = trees.Prizes([rng.random() for _ in range(n)], range(n - 1), range(1, n), [1.0] * (n - 1))
    limits, points, rounds = search.Limits(sum(prizes.prize), 1.0, 1.0, 1.0, n, True), {}, 0
    while True:
        lams, picks, met, ended = search.size_band(points, limits, 4, 6, 8, False)
        if picks:
            break
        points |= {lam: prizes.score(lam) for lam in lams}
        rounds += 1
    assert ended and rounds < 12 and (not met or 4 <= points[picks[0][1]][0] <= 6)


def values(nodes, edges, root):
    own = C.value(F.col("prize"), F.lit(1), F.lit(0.0), (F.col("node") == F.lit(root)).cast("int"))
    function = C.edge_function(F.col("cost"), F.col("cost"))
    return (nodes.select("problem_id", "node", F.when(F.lit(root is None), C.value(F.col("prize"), F.lit(1), F.lit(0.0), F.lit(0))).otherwise(own).alias("own")),
            edges.select("problem_id", F.col("src").alias("a"), F.col("dst").alias("b"), function.alias("ab"), function.alias("ba")))


@pytest.mark.parametrize("root", [None, 5])
def test_contracted_trees_have_the_same_values(spark, monkeypatch, root):
    """Paths, stars, caterpillars and random trees, raked and compressed down to a few nodes."""
    rng = random.Random(3)
    shapes = {0: lambda v: v - 1, 1: lambda v: 0, 2: lambda v: v - 1 if v % 2 else max(0, v - 2), 3: lambda v: rng.randrange(max(0, v - 4), v), 4: rng.randrange}
    cases = {k: (n, [rng.choice([0.0, 0.0, 0.4, 2.0, 5.0]) for _ in range(n)], [(at(v), v, rng.choice([0.0, 0.5, 1.0, 3.0])) for v in range(1, n) if k < 4 or rng.random() < 0.9])
             for k, at in shapes.items() for n in [150]}
    edges, nodes = frames(spark, cases)
    results = []
    for limit in (trees.LIMIT, 100):
        monkeypatch.setattr(trees, "LIMIT", limit)
        payoffs, sent, rounds = C.tree_values(*values(nodes, edges, root))
        results.append(({(r.problem_id, r.node): tuple(r.payoff) for r in payoffs.collect()},
                        {(r.problem_id, r.a, r.b): (*r.ab, *r.ba) for r in sent.collect()}))
        assert (rounds > 0) == (limit == 100)
    for one, other in zip(*results):
        assert one.keys() == other.keys() and len(one) > 0
        for key, x in one.items():
            assert x == pytest.approx(other[key], abs=1e-9), key


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(trees, "LIMIT", 1 << 14)
    n = 100_000
    edges = spark.range(n - 1).select(F.lit(0).cast("long").alias("problem_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("cost"))
    nodes = spark.range(n).select(F.lit(0).cast("long").alias("problem_id"), F.col("id").alias("node"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 400.0).alias("prize"))
    payoffs, _, rounds = C.tree_values(*values(nodes, edges, None))
    assert 0 < rounds < 40
    prizes = [r.prize for r in nodes.orderBy("node").collect()]
    left, right = [0.0] * n, [0.0] * n
    for v in range(1, n):
        left[v] = max(0.0, left[v - 1] + prizes[v - 1] - 1.0)
    for v in range(n - 2, -1, -1):
        right[v] = max(0.0, right[v + 1] + prizes[v + 1] - 1.0)
    got = {r.node: r.m for r in payoffs.select("node", "payoff.m").collect()}
    assert len(got) == n and all(abs(got[v] - left[v] - prizes[v] - right[v]) < 1e-6 for v in range(n))


def test_large_problems_by_rounds(spark, monkeypatch):
    """With almost no room in a task, every operator returns what it returns with plenty."""
    rng = random.Random(11)
    cases = {}
    for k in range(2):
        n = 40
        es = {(rng.randrange(v), v) for v in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(25)}
        cases[k] = (n, [rng.choice([0.1, 1.5, 3.0]) * rng.uniform(0.9, 1.1) for _ in range(n)], [(u, v, rng.uniform(0.5, 2.0)) for u, v in sorted(es)])
    cases[2] = (3, [1.0, 2.0, 0.5], [(0, 1, 1.0), (1, 2, 1.0)])
    edges, nodes = frames(spark, cases)
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    runs = []
    for limit in (trees.LIMIT, 60):
        monkeypatch.setattr(trees, "LIMIT", limit)
        runs.append([plain(x) for x in (
            G.components(edges).select("problem_id", "node", "comp"), FO.spanning_forest(edges).select("problem_id", "src", "dst"),
            FO.size_band(edges, nodes, 8, 10).select("problem_id", "node", "in_band", "converged"),
            FO.cost_tail(edges, nodes, 4.0, 2.6).select("problem_id", "node", "in_band", "converged"),
            FO.cost_head(edges, nodes, 4.0).select("problem_id", "node", "converged"),
            FO.prize_collecting(edges, nodes, root=7, lam=1.1)[0].select("problem_id", "node"),
            FO.prize_collecting(edges, nodes, g=2, lam=1.6)[0].select("problem_id", "node", "comp"))])
    for name, one, other in zip("components forest band tail head rooted two".split(), *runs):
        assert one == other, name


def test_searches_take_more_rows_than_other_work(spark, monkeypatch):
    """Problems beyond ``LIMIT`` are searched in a task up to ``SEARCHED``, and beyond that by rounds, with one result."""
    rng = random.Random(12)
    cases = {}
    for k in range(2):
        n = 40
        es = {(rng.randrange(v), v) for v in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(25)}
        cases[k] = (n, [rng.choice([0.1, 1.5, 3.0]) * rng.uniform(0.9, 1.1) for _ in range(n)], [(u, v, rng.uniform(0.5, 2.0)) for u, v in sorted(es)])
    edges, nodes = frames(spark, cases)
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    rounds = FO._searched_by_rounds
    monkeypatch.setattr(trees, "LIMIT", 60)
    runs = []
    for searched in (1 << 20, 60):
        monkeypatch.setattr(trees, "SEARCHED", searched)
        monkeypatch.setattr(FO, "_searched_by_rounds", rounds if searched == 60 else lambda *a: pytest.fail("rounds for a problem that fits a task"))
        runs.append([plain(x) for x in (
            FO.size_band(edges, nodes, 8, 10).select("problem_id", "node", "in_band", "converged"),
            FO.cost_head(edges, nodes, 4.0).select("problem_id", "node", "converged"),
            FO.cost_tail(edges, nodes, 4.0, 2.6).select("problem_id", "node", "in_band", "converged"),
            FO.prize_collecting(edges, nodes, root=7, lam=1.1)[0].select("problem_id", "node"))])
    assert runs[0] == runs[1]


@pytest.mark.parametrize("above", [lambda v: v - 1, lambda v: 0, lambda v: int(v * 0.618) % v])
@pytest.mark.parametrize("root", [None, 17])
def test_forests_in_arrays(monkeypatch, above, root):
    """Deep and wide trees in arrays give what they give as lists."""
    rng = random.Random(6)
    n = 500
    links = [(above(v), v) for v in range(1, n) if rng.random() < 0.98]
    rng.shuffle(links)
    a, b, cost = [u for u, _ in links], [v for _, v in links], [rng.choice([0.5, 1.0, 3.0]) for _ in links]
    prize = [rng.choice([0.0, 0.0, 0.5, 1.1, 2.0, 5.0]) for _ in range(n)]
    lists = trees.Prizes(prize, a, b, cost, root)
    monkeypatch.setattr(trees, "WIDE", 100)
    arrays = trees.Prizes(prize, a, b, cost, root)
    assert lists.wide is None and arrays.wide is not None and (lists.steps is None) == (arrays.steps is None)
    for lam in (0.0, 0.1, 0.5, 1.0, 1.5, 4.0, 100.0):
        assert arrays.score(lam) == lists.score(lam)
        for g in (1, 3):
            for one, other in zip(arrays.best(lam, g), lists.best(lam, g), strict=True):
                assert one[:3] == other[:3] and sorted(one[3]) == sorted(other[3])
                assert sorted(arrays.edges(one[3])) == sorted(lists.edges(other[3]))


def test_a_search_holds_few_bytes_a_row():
    draw = np.random.default_rng(2)
    n, m = 20_000, 40_000
    src, dst = draw.integers(0, n, m), draw.integers(0, n, m)
    table = pa.table({"src": np.concatenate([np.arange(n), src]), "dst": pa.array(np.concatenate([np.arange(n), dst]), mask=np.arange(n + m) < n),
                      "value": draw.integers(1, 50, n + m) / 2.0})
    tracemalloc.start()
    problem = FO._Problem(table, None)
    size, _, _ = problem.prizes.score(0.5)
    assert problem.chosen([(0, 0.5)], 1, True, True)["node"].null_count == size - 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > n / 2 and most < 120 * (n + m), most / (n + m)


def test_a_table_is_written_once(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    table = lineage.cut(spark.range(1000).repartition(7, "id"))
    assert lineage.cut(table) is table and table.count() == 1000 and spark.conf.get(key) == before
    with lineage.folder("apart") as name:
        again = lineage.cut(table)
        assert again is not table and lineage.cut(again) is again
    lineage.clear(spark, name)
    assert table.count() == 1000 and lineage.cut(table) is table
