"""Graph operators against literal cases and small exhaustive searches."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF
from sparsetab.operators import forest as FO, graph as G, relational as R
from sparsetab.plans.inputs import graph_edges, graph_nodes

E_SCHEMA = "problem_id long, src long, dst long, cost double"
N_SCHEMA = "problem_id long, node long, prize double"

# Asserted cases of the prize-collecting solver, as
# (case, root, g, edges, prizes, costs, nodes).
CASES = [
    (3, None, 1, [(0, 1), (1, 2)], [0, 5, 6], [3, 4], {1, 2}),
    (4, None, 1, [(0, 1), (1, 2)], [0, 5, 6], [3, 4], {1, 2}),
    (6, 0, 0, [(0, 1), (1, 2), (2, 3)], [10, 0, 1, 10], [10, 4, 3], {0}),
    (10, 0, 0, [(0, 1), (1, 2)], [10, 3, 3], [100, 2], {0}),
    (11, None, 2, [(0, 1), (1, 2)], [10, 3, 3], [100, 2], {0, 1, 2}),
    (12, None, 1, [(0, 1), (1, 2)], [10, 3, 3], [100, 2], {0}),
    (13, None, 2, [(0, 1), (1, 2), (2, 3)], [10, 0, 6, 6], [100, 2, 5], {0, 2, 3}),
    (15, None, 1, [(i, i + 1) for i in range(7)], [100, 0, 0, 1, 0, 0, 0, 100], [0.9] * 7, set(range(8))),
    (16, None, 1, [(0, 1), (0, 2), (2, 3), (3, 4)], [0, 2.2, 0, 0, 2.1], [1] * 4, {1}),
    (18, None, 1, [(0, 1), (1, 2)], [2, 2, 2], [0, 5], {0, 1}),
]


def frames(spark, cases):
    edges = [(c, u, v, float(w)) for c, _, _, es, _, cs, _ in cases for (u, v), w in zip(es, cs)]
    nodes = [(c, i, float(p)) for c, _, _, _, ps, _, _ in cases for i, p in enumerate(ps)]
    return spark.createDataFrame(edges, E_SCHEMA), spark.createDataFrame(nodes, N_SCHEMA)


def supports(df):
    found = {}
    for row in df.collect():
        found.setdefault(row.problem_id, set()).add(row.node)
    return found


def best_subtree(nodes, edges):
    """Payoff of the best connected subgraph of a forest, by trying all edge sets and single nodes."""
    best = max(nodes.values())
    for size in range(1, len(edges) + 1):
        for chosen in itertools.combinations(edges, size):
            seen, todo = {chosen[0][0]}, True
            while todo:
                todo = False
                for u, v, _ in chosen:
                    if (u in seen) != (v in seen):
                        seen |= {u, v}
                        todo = True
            if seen == {x for u, v, _ in chosen for x in (u, v)}:
                best = max(best, sum(nodes[n] for n in seen) - sum(c for _, _, c in chosen))
    return best


def test_prize_collecting_cases(spark):
    rng = random.Random(4)
    trees = {}
    for case in range(100, 112):
        size = rng.randint(4, 9)
        es = [(rng.randrange(v), v) for v in range(1, size)]
        trees[case] = (case, None, 1, es, [rng.choice([0, 0.3, 1.1, 2.7, 4.2]) for _ in range(size)], [rng.choice([0.5, 1.0, 1.5]) for _ in es], None)
    # A case whose asserted node set 0..4 pays 0.3; any better one will do.
    trees[17] = (17, None, 1, [(0, 1), (0, 2), (2, 3), (3, 4)], [0, 2.2, 0, 0, 2.1], [1] * 4, None)
    free = [c for c in CASES if c[1] is None and c[2] == 1] + list(trees.values())
    edges, nodes = frames(spark, free)
    support, kept = FO.prize_collecting(edges, nodes, g=1)
    got, links = supports(support), kept.groupBy("problem_id").agg(F.sum("c").alias("c")).collect()
    cost = {r.problem_id: r.c for r in links}
    for case in free:
        if case[6] is not None:
            assert got[case[0]] == case[6], case[0]
            continue
        _, _, _, es, ps, cs, _ = case
        value = sum(ps[n] for n in got[case[0]]) - cost.get(case[0], 0.0)
        want = best_subtree(dict(enumerate(ps)), [(u, v, c) for (u, v), c in zip(es, cs)])
        assert value == pytest.approx(want), case[0]


def test_several_trees_and_root(spark):
    two = [c for c in CASES if c[2] == 2]
    edges, nodes = frames(spark, two)
    got = supports(FO.prize_collecting(edges, nodes, g=2)[0])
    assert got == {c[0]: c[6] for c in two}
    rooted = [c for c in CASES if c[1] == 0]
    eight = (8, 0, 0, [(0, 1), (1, 2), (2, 3)], [10, 10, 1, 10], [10, 6, 5], None)
    edges, nodes = frames(spark, [*rooted, eight])
    support, kept = FO.prize_collecting(edges, nodes, root=0)
    got = supports(support)
    for case in rooted:
        assert got[case[0]] == case[6]
    spent = kept.filter("problem_id = 8").agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0]
    assert sum(eight[4][n] for n in got[8]) - spent == pytest.approx(10.0)


def random_graph(rng, size, extra):
    edges = {(rng.randrange(v), v): float(rng.randint(1, 9)) for v in range(1, size) if rng.random() < 0.8}
    while len(edges) < extra:
        u, v = sorted(rng.sample(range(size), 2))
        edges.setdefault((u, v), float(rng.randint(1, 9)))
    return edges


def union_find(size, edges):
    parent = list(range(size))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(size)]


def test_components_and_forest(spark):
    rng = random.Random(1)
    graphs = {k: random_graph(rng, 30, 28) for k in range(5)}
    graphs[5] = {(i, i + 1): 1.0 for i in range(60)}
    edges = spark.createDataFrame([(k, u, v, c) for k, es in graphs.items() for (u, v), c in es.items()], E_SCHEMA)
    labels = {(r.problem_id, r.node): r.comp for r in G.components(edges.repartition(3)).collect()}
    forest = {}
    for r in FO.spanning_forest(edges).collect():
        forest.setdefault(r.problem_id, []).append((r.src, r.dst, r.cost))
    for k, es in graphs.items():
        want = union_find(61, es)
        assert all(labels[k, n] == want[n] for e in es for n in e)
        kept, order = [], sorted(es, key=lambda e: (es[e], e))
        for e in order:
            owner = union_find(61, kept)
            if owner[e[0]] != owner[e[1]]:
                kept.append(e)
        assert sorted((u, v, es[u, v]) for u, v in kept) == sorted(forest[k])


def lattice_frames(spark, width, prizes):
    cells = spark.range(width * width).select((F.col("id") / width).cast("long").alias("r"), (F.col("id") % width).alias("c"))
    edges = G.lattice(cells, width).withColumn("problem_id", F.lit(0).cast("long"))
    nodes = spark.createDataFrame([(0, i, float(p)) for i, p in enumerate(prizes)], N_SCHEMA)
    return edges, nodes


def test_lattice_counts(spark):
    assert lattice_frames(spark, 5, [])[0].count() == 40
    flat = spark.range(15).select((F.col("id") / 5).cast("long").alias("r"), (F.col("id") % 5).alias("c"))
    assert G.lattice(flat, 5).count() == 22
    assert G.full_lattice(flat, 5, F.lit(3)).count() == 22


def test_size_band_finds_blob(spark):
    blob = {6, 7, 8, 11, 12, 13}
    edges, nodes = lattice_frames(spark, 5, [3.0 if i in blob else 0.01 for i in range(25)])
    assert supports(FO.size_band(edges, nodes, 6, 6))[0] == blob


def test_size_band_returns_every_problem(spark):
    """A path without costs and one without prizes stay, marked as out of band; a size on a lattice is met."""
    edges = spark.createDataFrame([(0, i, i + 1, 0.0) for i in range(9)] + [(1, i, i + 1, 1.0) for i in range(4)], E_SCHEMA)
    nodes = spark.createDataFrame([(0, i, 1.0) for i in range(10)] + [(1, i, 0.0) for i in range(5)] + [(2, 7, 3.0)], N_SCHEMA)
    got = FO.size_band(edges, nodes, 3, 4).collect()
    assert {r.problem_id for r in got} == {0, 1, 2} and not any(r.in_band for r in got)
    rng = random.Random(4)
    grid, prizes = lattice_frames(spark, 8, [rng.random() ** 3 for _ in range(64)])
    band = FO.size_band(grid, prizes, 8, 9).collect()
    assert all(r.in_band == (8 <= len(band) <= 9) for r in band) and 0 < len(band) <= 9
    lone = spark.createDataFrame([(5, 1, 0.0), (5, 2, 0.0)], N_SCHEMA)
    assert supports(FO.cost_head(edges.limit(0), lone, 1.0)) == supports(FO.cost_tail(edges.limit(0), lone, 1.0, 2.0)) == {5: {1}}


def test_root_beside_a_large_prize(spark):
    """The root's tree does not depend on prizes elsewhere; a root that pays nothing stays."""
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.0), (1, 0, 1, 5.0), (1, 1, 2, 1.0)], E_SCHEMA)
    nodes = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0005), (0, 2, 1.0005), (0, 9, 1e9), (1, 0, 0.0), (1, 1, 3.0), (1, 2, 3.0)], N_SCHEMA)
    support, kept = FO.prize_collecting(edges, nodes, root=0)
    assert supports(support)[0] == {0, 1, 2}
    assert supports(support)[1] == {0}  # 6 - 1 - 5 = 0 does not pay for the edge
    assert kept.filter("problem_id = 0").count() == 2


def test_budget_searches(spark):
    """Two blobs far apart: a head within its cost bound, a tail inside its cost band."""
    prizes = [4.0 if i in (0, 1, 5, 6) else 2.0 if i in (22, 23, 24) else 0.1 for i in range(25)]
    edges, nodes = lattice_frames(spark, 5, prizes)
    head = supports(FO.cost_head(edges, nodes, budget=2.0, max_rounds=3))[0]
    assert head >= {0, 1, 5, 6} or len(head) >= 3
    assert len(head) - 1 <= 4
    tail = supports(FO.cost_tail(edges, nodes, budget=1.5, nu=3.0, max_rounds=3))[0]
    assert 3 <= len(tail) - 1 <= 4.5


def test_budget_trim(spark):
    members = spark.createDataFrame([(0, 1, 1, 9.0), (0, 2, 1, 1.0), (0, 5, 5, 3.0), (0, 6, 5, 2.0), (0, 9, 9, 1.0)], "problem_id long, node long, comp long, prize double")
    kept = spark.createDataFrame([(0, 1, 2, 4.0), (0, 5, 6, 5.0)], E_SCHEMA)
    assert supports(FO.budget_trim(members, kept, 5.0))[0] == {9, 1, 2, 5}


def test_walks_are_connected(spark):
    edges, _ = lattice_frames(spark, 4, [])
    starts = spark.createDataFrame([(0, w, 8) for w in range(6)], "problem_id long, walk_id int, node long")
    walks = G.random_walks(edges, starts, 5, seed=2, restart=0.2).collect()
    assert len(walks) == 6
    for walk in walks:
        assert len(walk.nodes) == 5 and 8 in walk.nodes and walk.complete
        pairs = [(e.src, e.dst) for e in walk.walked]
        owner = union_find(16, pairs)
        assert len({owner[n] for n in walk.nodes}) == 1
    far = spark.createDataFrame([(0, 0, 1)], "problem_id long, walk_id int, node long")
    short = spark.createDataFrame([(0, 1, 2, 1.0)], E_SCHEMA)
    only = G.random_walks(short, far, 5).collect()
    assert len(only) == 1 and not only[0].complete and set(only[0].nodes) == {1, 2}


# The one asserted case on a graph with cycles, rooted at node 3.
U14 = [0, 1, 2, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 3, 4, 4, 4, 5, 6]
V14 = [1, 2, 3, 9, 2, 3, 5, 9, 3, 5, 7, 8, 3, 4, 5, 6, 7, 8, 9, 5, 6, 7, 8, 8]
DEAR14 = {2, 5, 8, 12, 13, 14, 15, 16, 17, 18}
P14 = [0.032052554364677466, 0.32473378289799926, 0.069699345546302638, 0.0, 0.74867253235151754, 0.19804330340026255,
       0.85430521133171622, 0.83819939651391351, 0.71744625276884877, 0.016798567754083948]


def test_rooted_case_with_cycles(spark):
    costs = [0.88 if i in DEAR14 else 0.8 for i in range(24)]
    edges, nodes = frames(spark, [(14, 3, 0, list(zip(U14, V14)), P14, costs, None)])
    support, kept = FO.prize_collecting(edges, nodes, root=3)
    got = supports(support)[14]
    spent = kept.agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0]
    asserted = sum(P14[n] for n in (3, 4, 6, 7, 8)) - (0.88 + 3 * 0.8)
    assert 3 in got and sum(P14[n] for n in got) - spent >= asserted - 1e-9


def test_budget_searches_say_whether_they_ended(spark):
    """A search that stops short says so, one with nothing to search for has ended."""
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0)], E_SCHEMA)
    nodes = spark.createDataFrame([(0, 1, 0.01), (0, 2, 3.0), (0, 3, 3.0), (1, 5, 0.0)], N_SCHEMA)
    head = FO.cost_head(edges, nodes, budget=0.7, max_rounds=1).collect()
    assert {(r.problem_id, r.converged) for r in head} == {(0, False), (1, True)}
    short = FO.cost_tail(edges, nodes, budget=0.7, nu=2.1, max_rounds=1).collect()  # no forest costs 1.4 to 1.47
    assert {(r.problem_id, r.in_band, r.converged) for r in short} == {(0, False, False), (1, True, True)}


def test_registered_searches_are_not_cut(monkeypatch):
    from sparsetab.plans import graphs

    given = {}
    for name in ("graph_edges", "graph_nodes"):
        monkeypatch.setattr(graphs, name, lambda spark, sf: None)
    for name in ("size_band", "cost_head", "cost_tail"):
        monkeypatch.setattr(FO, name, lambda *args, _name=name, **more: given.update({_name: more}))
    graphs.g14(None, None), graphs.g15(None, None), graphs.g16(None, None)
    assert set(given) == {"size_band", "cost_head", "cost_tail"} and not any("max_rounds" in more for more in given.values())


def test_ranges_of_a_large_graph_are_merged_in_tasks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(p, a, a + 1, 1.0) for p in range(3) for a in (0, 148)]
    for p, local in enumerate((1.0, 0.9, 0.1)):  # share of edges inside a block of 30 nodes
        for _ in range(300):
            a = rng.randrange(150)
            rows.append((p, a, a // 30 * 30 + rng.randrange(30) if rng.random() < local else rng.randrange(150), float(rng.randrange(4))))
    edges = spark.createDataFrame(rows, "problem_id long, src long, dst long, cost double")
    labels, forest = ({tuple(r) for r in f(edges).collect()} for f in (G.components, FO.spanning_forest))
    monkeypatch.setattr(G.trees, "LIMIT", 130)
    assert {tuple(r) for r in G.components(edges).collect()} == labels
    assert {tuple(r) for r in FO.spanning_forest(edges).collect()} == forest

    def unused(*args, **kwargs):
        raise AssertionError("blocks that lie in one range need no rounds")

    for module in (G, FO):
        monkeypatch.setattr(module, "pointer_roots", unused)
    apart = edges.filter("problem_id = 0")
    assert {tuple(r) for r in G.components(apart).collect()} == {r for r in labels if r[0] == 0}
    assert {tuple(r) for r in FO.spanning_forest(apart).collect()} == {r for r in forest if r[0] == 0}


def sample_graph(spark):
    """Shapes that need care: cycles, ties, a long path, loops, ends without a prize, nodes without an edge."""
    rng = random.Random(8)
    edges = [(0, rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 5))) for _ in range(70)]
    edges += [(1, i, i + 1, 1.0 + i % 3) for i in range(80)] + [(2, 5, 5, 1.0), (2, 6, 7, 2.0), (2, 7, 900, 1.0), (3, 4, 4, 1.0)]
    nodes = [(p, v, float(rng.randrange(0, 9))) for p, n in ((0, 70), (1, 81), (2, 12)) for v in range(n)] + [(3, 4, 1.0), (4, 1, 2.0)]
    return spark.createDataFrame(edges, E_SCHEMA), spark.createDataFrame(nodes, N_SCHEMA)


def told(df, *names):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in df.collect())


@pytest.mark.parametrize("limit", [1 << 21, 100])
def test_payoffs_come_from_one_table_of_a_graph(spark, monkeypatch, limit):
    edges, nodes = sample_graph(spark)
    lams = nodes.select("problem_id").distinct().withColumn("lam", F.explode(F.array(F.lit(0.5), F.lit(2.0))))
    names = ["problem_id", "lam", "node", "payoff", "size"]
    expected = told(FO.tree_messages(FO.spanning_forest(edges), nodes, lams)[1], *names)
    monkeypatch.setattr(G.trees, "LIMIT", limit)
    if limit > 100:
        monkeypatch.setattr(FO, "tree_messages", lambda *a: pytest.fail("messages of a problem that fits a task"))
    assert told(FO.tree_payoffs(edges, nodes, lams), *names) == expected


@pytest.mark.parametrize("limit", [1 << 21, 100])
def test_totals_and_trims_come_from_one_table_of_a_graph(spark, monkeypatch, limit):
    edges, nodes = sample_graph(spark)
    labels, forest = G.components(edges), FO.spanning_forest(edges)
    names = ["problem_id", "comp", "prize", "size", "cost", "ratio"]
    totals = told(FO.forest_totals(nodes, forest, labels), *names)
    trims = [told(FO.budget_trim(labels.join(nodes, ["problem_id", "node"]), forest, b), "problem_id", "node") for b in (0.0, 9.0, 1e6)]
    monkeypatch.setattr(G.trees, "LIMIT", limit)
    if limit > 100:
        monkeypatch.setattr(FO, "spanning_forest", lambda *a: pytest.fail("a forest apart from its totals"))
    assert told(FO.graph_totals(edges, nodes), *names) == totals
    assert [told(FO.graph_trim(edges, nodes, b), "problem_id", "node") for b in (0.0, 9.0, 1e6)] == trims


def test_walks_and_summaries_read_edges_where_they_lie(spark, monkeypatch):
    """Few walks need no components, numbers of neighbours or shuffled edges; a summary needs no table of labels."""
    edges, _ = sample_graph(spark)
    around, expected = {}, {}
    for p, a, b, _ in edges.collect():
        around.setdefault((p, a), set()).add(b)
        around.setdefault((p, b), set()).add(a)
    starts = spark.createDataFrame([(p, w, v) for w, (p, v) in enumerate(sorted(around)) if v % 4 == 0] + [(7, 0, 1)], "problem_id long, walk_id long, node long")
    for p, w, v in starts.collect():
        seen = [v]
        for u in seen:
            seen += sorted(around.get((p, u), set()) - set(seen))
        expected[p, w] = set(seen)
    labels = G.graph_summary(edges, G.components(edges)).collect()
    monkeypatch.setattr(G, "components", lambda *a: pytest.fail("components of the whole graph"))
    for r in G.random_walks(edges, starts, 4, seed=2).collect():
        whole = expected.pop((r.problem_id, r.walk_id))
        assert r.complete == (len(whole) >= 4) and len(r.nodes) == min(4, len(whole)) and set(r.nodes) <= whole
        assert all(e.dst in around[r.problem_id, e.src] for e in r.walked)
    assert not expected
    assert {tuple(r) for r in G.graph_totals(edges).collect()} == {tuple(r) for r in labels}


def test_nodes_chosen_in_all_problems(spark):
    edges, _ = sample_graph(spark)
    some = spark.range(0, 60, 2).selectExpr("id as node")
    each = edges.select("problem_id").distinct().crossJoin(some)
    one, two = ({tuple(r) for r in FO.unpruned(edges, chosen).collect()} for chosen in (some, each))
    assert one == two and one


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    want = sorted(graph_edges(spark, SF).collect())
    monkeypatch.setattr(R, "TASK_ROWS", 500)
    got = graph_edges(spark, SF).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r[:-1] for r in got) == want
    assert max(Counter(r.task for r in got).values()) < 1000


def test_nodes_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    want = sorted((r.problem_id, r.node, round(r.prize, 6)) for r in graph_nodes(spark, SF).collect())
    monkeypatch.setattr(R, "TASK_ROWS", 500)
    got = graph_nodes(spark, SF).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.problem_id, r.node, round(r.prize, 6)) for r in got) == want
    assert max(Counter(r.task for r in got).values()) < 1000
