"""Graph tables: ``edges(problem_id, src, dst, cost)`` and ``nodes(problem_id, node, prize)``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sparsetab.functions.scalar import hashed_unit
from sparsetab.lineage import cut, cut_count
from sparsetab.operators import trees
from sparsetab.operators.relational import edges_within
from sparsetab.operators.trees import by_problem, column, least_labels

KEY = "problem_id"


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with the smaller end first."""
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def lattice(cells: DataFrame, width: int) -> DataFrame:
    """G1. Edges between 4-neighbours of a cell table ``cells(r, c)``.

    A neighbour is looked up by its own cell key, so holes in the table stay
    holes in the graph.  Node ids are row-major.
    """
    here = cells.select("r", "c")
    steps = F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))
    wanted = here.withColumn("_s", F.explode(steps)).select(
        (F.col("r") * width + F.col("c")).cast("long").alias("src"),
        (F.col("r") + F.col("_s.dr")).alias("r"), (F.col("c") + F.col("_s.dc")).alias("c"),
    )
    return wanted.join(here, ["r", "c"], "left_semi").select(
        "src", (F.col("r") * width + F.col("c")).cast("long").alias("dst"), F.lit(1.0).alias("cost")
    )


def full_lattice(cells: DataFrame, width: int, height: Column) -> DataFrame:
    """G1. Lattice over a table known to hold every cell: a projection, no join."""
    ends = F.array(
        F.when(F.col("c") + 1 < width, F.struct(F.col("r").alias("r"), (F.col("c") + 1).alias("c"))),
        F.when(F.col("r") + 1 < height, F.struct((F.col("r") + 1).alias("r"), F.col("c").alias("c"))),
    )
    return cells.withColumn("_e", F.explode(ends)).filter(F.col("_e").isNotNull()).select(
        (F.col("r") * width + F.col("c")).cast("long").alias("src"),
        (F.col("_e.r") * width + F.col("_e.c")).cast("long").alias("dst"),
        F.lit(1.0).alias("cost"),
    )


def add_root(edges: DataFrame, nodes: DataFrame, root: int, gamma: float) -> DataFrame:
    """G2. A root joined to every node at cost ``1 + gamma``."""
    spokes = nodes.select(KEY, F.lit(root).cast("long").alias("src"), F.col("node").alias("dst"), F.lit(1.0 + gamma).alias("cost"))
    return edges.select(KEY, "src", "dst", "cost").unionByName(spokes)


def random_costs(edges: DataFrame, seed: int) -> DataFrame:
    """G3. Costs in [1, 2) drawn from a hash of the edge, equal on every run."""
    unit = hashed_unit(seed, KEY, "src", "dst")
    return edges.withColumn("cost", 1.0 + unit)


def induced(edges: DataFrame, nodes: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """G4. Subgraph on a node set, without self-loops."""
    return edges_within(edges, nodes, on).filter(F.col("src") != F.col("dst"))


def endpoints(edges: DataFrame, *more: str) -> DataFrame:
    return (
        edges.select(KEY, F.col("src").alias("node"), *more)
        .unionByName(edges.select(KEY, F.col("dst").alias("node"), *more))
    )


def pointer_roots(pointers: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Root of every vertex of a forest of ``(problem_id, c, parent)`` pointers.

    Pointers are doubled until all reach a root; the number of rounds grows with
    the logarithm of the depth.  ``carry`` names columns passed through.
    """
    current = cut(pointers.select(KEY, "c", "parent", *carry))
    moved = 1
    while moved:
        up = current.selectExpr(KEY, "c as parent", "parent as up")
        current, moved = cut_count(
            current.join(up, [KEY, "parent"], "left").selectExpr(
                KEY, "c", "coalesce(up, parent) as parent", *carry, "coalesce(up <> parent, false) as moved"
            ),
            "moved",
        )
        current = current.drop("moved")
    return current


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """G5. Component of every node, named by its least node id: ``(problem_id, node, comp)``.

    A problem that fits a task is finished there.  A larger one is first cut into ranges of node ids that fit one
    each, which leaves the edges between ranges; where most edges are such ones, every component points to its least
    neighbour instead and the pointer trees are contracted, which at least halves their number.  ``nodes`` adds nodes
    without edges.
    """
    table, left = cut_count(edges.selectExpr(KEY, "least(src, dst) as a", "greatest(src, dst) as b"), "a <> b")
    labels = cut(_labels(table.filter("a <> b"), left))
    alone = table.filter("a = b").select(KEY, F.col("a").alias("node"))
    if nodes is not None:
        alone = alone.unionByName(nodes.select(KEY, "node"))
    elif alone.isEmpty():
        return labels
    rest = alone.distinct().join(labels.select(KEY, "node"), [KEY, "node"], "left_anti")
    return cut(labels.unionByName(rest.select(KEY, "node", F.col("node").alias("comp"))))


def _labels(live: DataFrame, left: int) -> DataFrame:
    """Component of every end of the edges ``(problem_id, a, b)``."""

    def finish(table):
        node, root = least_labels(column(table, "a"), column(table, "b"))
        return {"node": node, "comp": root}

    kinds = "node long, comp long"
    large = _oversized(live, left)
    if large is None:
        return by_problem(live, KEY, finish, kinds)
    solved = by_problem(live.join(large, KEY, "left_anti"), KEY, finish, kinds)
    parted, inside = parts(live, large)
    if 2 * inside >= parted.count():
        local = by_problem(parted.filter("part is not null").select(F.struct(KEY, "part").alias(KEY), "a", "b"), KEY, finish, kinds)
        roots = cut(local.select(F.col(f"{KEY}.{KEY}").alias(KEY), "node", "comp"))
        between = parted.filter("part is null").select(KEY, "a", "b")
    else:
        between = parted.select(KEY, "a", "b")
        hooks = between.selectExpr(KEY, "inline(array(struct(a as c, b as o), struct(b as c, a as o)))").groupBy(KEY, "c").agg(F.min("o").alias("o")).selectExpr(KEY, "c", "least(c, o) as parent")
        roots = pointer_roots(hooks).selectExpr(KEY, "c as node", "parent as comp")
    # ends of edges that are left and have no root yet are roots of their own
    pointers = roots.withColumnsRenamed({"node": "c", "comp": "parent"})
    more, left = cut_count(
        _relabel(_relabel(between, "a", pointers), "b", pointers).filter("a <> b").selectExpr(KEY, "least(a, b) as a", "greatest(a, b) as b").distinct(), "true")
    if left:
        above = cut(_labels(more, left))
        bare = above.join(roots.select(KEY, "node"), [KEY, "node"], "left_anti")
        roots = _relabel(roots, "comp", above.withColumnsRenamed({"node": "c", "comp": "parent"})).select(KEY, "node", "comp").unionByName(bare)
    return solved.unionByName(roots)


def _oversized(rows: DataFrame, total: int | None = None, limit: int | None = None) -> DataFrame | None:
    """Problems with more rows than a task takes; None if there are none, as there cannot be if ``total`` is that small."""
    limit = trees.LIMIT if limit is None else limit
    if total is not None and total <= limit:
        return None
    large, found = cut_count(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(KEY), "true")
    return large if found else None


def parts(live: DataFrame, large: DataFrame) -> tuple[DataFrame, int]:
    """Edges of large problems with the ``part`` that holds both their ends, and how many have one.

    Parts are ranges of node ids, each of half a task's rows if ids are spread evenly; one that has more rows than a task takes is none.
    """
    mine = live.join(large, KEY, "left_semi")
    ranges = mine.groupBy(KEY).agg(F.min("a").alias("_lo"), ((F.max("b") - F.min("a") + 1) / F.ceil(2 * F.count(F.lit(1)) / trees.LIMIT)).alias("_width"))
    of = lambda end: F.floor((F.col(end) - F.col("_lo")) / F.col("_width")).cast("int")
    parted = cut(mine.join(ranges, KEY).withColumn("part", F.when(of("a") == of("b"), of("a"))).drop("_lo", "_width"))
    sizes, crowded = cut_count(parted.filter("part is not null").groupBy(KEY, "part").agg(F.count(F.lit(1)).alias("_n")), f"_n > {trees.LIMIT}")
    inside = sizes.agg(F.sum("_n")).first()[0] or 0
    if crowded:
        crowds = sizes.filter(f"_n > {trees.LIMIT}").select(KEY, "part", F.lit(True).alias("_crowd"))
        inside -= sizes.filter(f"_n > {trees.LIMIT}").agg(F.sum("_n")).first()[0]
        parted = parted.join(crowds, [KEY, "part"], "left").withColumn("part", F.when(F.col("_crowd").isNull(), F.col("part"))).drop("_crowd")
    return parted, inside


def _relabel(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    renamed = roots.selectExpr(KEY, f"c as {column}", "parent as _root")
    rest = [c for c in df.columns if c != column]
    return df.join(renamed, [KEY, column], "left").selectExpr(*rest, f"coalesce(_root, {column}) as {column}")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(KEY, "comp").agg(F.count(F.lit(1)).alias("size"))


def large_components(labels: DataFrame, more_than: int = 5) -> DataFrame:
    """G6. Nodes of components with more than ``more_than`` nodes."""
    big = component_sizes(labels).filter(F.col("size") > more_than)
    return labels.join(big, [KEY, "comp"])


def largest_component(labels: DataFrame, more_than: int = 5) -> DataFrame:
    """G6. The largest component per problem; the least node id decides ties."""
    best = (
        component_sizes(labels).filter(F.col("size") > more_than)
        .groupBy(KEY).agg(F.min_by("comp", F.struct(-F.col("size"), "comp")).alias("comp"))
    )
    return labels.join(best, [KEY, "comp"], "left_semi")


def graph_summary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """A10. Components, edges, nodes and id range per problem."""
    sides = edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("edges"))
    ends = labels.groupBy(KEY).agg(
        F.count_if(F.col("node") == F.col("comp")).alias("components"),
        F.count(F.lit(1)).alias("nodes"), F.min("node").alias("min_node"), F.max("node").alias("max_node"),
    )
    return ends.join(sides, KEY)


def graph_totals(edges: DataFrame) -> DataFrame:
    """A10. ``graph_summary`` of a graph and its components; a problem that fits a task is summed up there."""
    table, left = cut_count(edges.select(KEY, "src", "dst"), "true")
    large = _oversized(table, left)

    def run(rows):
        a, b = column(rows, "src"), column(rows, "dst")
        node, root = least_labels(a, b)
        told = {"components": (node == root).sum(), "nodes": len(node), "min_node": node[0], "max_node": node[-1], "edges": len(a)}
        return {name: np.array([v], dtype=np.int64) for name, v in told.items()}

    fits = table if large is None else table.join(large, KEY, "left_anti")
    totals = by_problem(fits, KEY, run, "components long, nodes long, min_node long, max_node long, edges long")
    if large is None:
        return totals
    rest = cut(table.join(large, KEY, "left_semi"))
    return totals.unionByName(graph_summary(rest, components(rest)))


def random_walks(edges: DataFrame, starts: DataFrame, s: int, seed: int = 0, restart: float = 0.0, max_steps: int | None = None) -> DataFrame:
    """G8. Connected random subgraphs: one walk per row of ``starts(problem_id, walk_id, node)``.

    Each walk steps to a neighbour drawn by hash until it has seen ``s`` nodes.
    A step reads the edges and keeps the neighbours of the nodes that walks are at;
    no edge is shuffled for it where walks are few.  A walk whose component is smaller than ``s`` is
    found before the first step and reported with ``complete = false`` and the
    whole component as its nodes.  Returns one row per walk with the arrays
    ``nodes`` (at most ``s``) and ``walked`` (distinct edges).
    """
    start = starts.join(_reached(edges, starts.select(KEY, "walk_id", "node"), s), [KEY, "walk_id"])
    first = start.select(
        KEY, "walk_id", F.col("node").alias("start"), "node", F.array("node").alias("visited"),
        F.array().cast("array<struct<src:bigint,dst:bigint>>").alias("walked"), F.lit(0).alias("step"),
        (F.size("reach") >= s).alias("complete"), F.lit(s <= 1).alias("done"), "reach",
    )
    first = cut(first)
    whole = first.filter(~F.col("complete")).select(KEY, "walk_id", F.col("reach").alias("nodes"))
    first = first.drop("reach")
    finished = [first.filter(F.col("complete") & F.col("done"))]
    state, rounds = first.filter(F.col("complete") & ~F.col("done")), 0
    left = not state.isEmpty()
    while left:
        state, left = cut_count(_walk_step(state, edges, s, seed, restart), "not done")
        finished.append(state.filter("done"))
        state = state.filter("not done")
        rounds += 1
        if max_steps is not None and rounds >= max_steps and left:
            raise RuntimeError(f"walks did not see {s} nodes within {max_steps} steps")
    seen = finished[0]
    for part in finished[1:]:
        seen = seen.unionByName(part)
    walks = seen.select(KEY, "walk_id", F.col("visited").alias("nodes"), "walked", F.lit(True).alias("complete"))
    return walks.unionByName(
        whole.select(KEY, "walk_id", "nodes", F.array().cast(walks.schema["walked"].dataType).alias("walked"), F.lit(False).alias("complete"))
    )


def _neighbours(edges: DataFrame, at: DataFrame) -> DataFrame:
    """Sorted neighbours of the nodes ``at(problem_id, walk_id, node)`` of each walk; Spark sends few walks to the edges, not edges to the walks."""
    ends = edges.select(KEY, F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("node"), F.col("src").alias("to")))))
    return ends.join(at, [KEY, "node"]).groupBy(KEY, "walk_id").agg(F.array_sort(F.collect_set("to")).alias("near"))


def _reached(edges: DataFrame, starts: DataFrame, s: int) -> DataFrame:
    """Nodes ``reach`` of the component of every start: all of them, or ``s`` and more of a component that has as many."""
    state = starts.select(KEY, "walk_id", F.array("node").alias("reach"), F.lit(s <= 1).alias("closed"))
    for _ in range(max(0, s - 1)):
        near = _neighbours(edges, state.filter("not closed").select(KEY, "walk_id", F.explode("reach").alias("node")))
        grown = F.array_union("reach", F.coalesce(F.slice("near", 1, 2 * s), F.array().cast(state.schema["reach"].dataType)))
        state, left = cut_count(
            state.join(near, [KEY, "walk_id"], "left").withColumn("_grown", F.when(F.col("closed"), F.col("reach")).otherwise(grown)).select(
                KEY, "walk_id", F.col("_grown").alias("reach"),
                (F.col("closed") | (F.size("_grown") >= s) | (F.size("_grown") == F.size("reach"))).alias("closed")),
            "not closed")
        if not left:
            break
    return state.drop("closed")


def _walk_step(state: DataFrame, edges: DataFrame, s: int, seed: int, restart: float) -> DataFrame:
    """One step of walks that are not done."""
    draw = F.pmod(F.xxhash64(F.lit(seed), KEY, "walk_id", "step"), F.size("near"))
    coin = F.pmod(F.xxhash64(F.lit(seed + 1), KEY, "walk_id", "step"), F.lit(1 << 30)) / float(1 << 30)
    near = _neighbours(edges, state.select(KEY, "walk_id", "node"))
    moved = state.join(near, [KEY, "walk_id"]).withColumn("to", F.get("near", draw.cast("int")))
    visited = F.array_union("visited", F.array("to"))
    edge = F.struct(F.least("node", "to").alias("src"), F.greatest("node", "to").alias("dst"))
    return moved.select(
        KEY, "walk_id", "start", F.when(coin < restart, F.col("start")).otherwise(F.col("to")).alias("node"),
        visited.alias("visited"), F.array_union("walked", F.array(edge)).alias("walked"),
        (F.col("step") + 1).alias("step"), "complete", (F.size(visited) >= s).alias("done"),
    )


def node_set_scores(truth: DataFrame, found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """G9. Precision, recall and F of a found node set; 0 where a set is empty."""
    sides = (
        truth.select(*keys, "node").distinct().withColumns({"_t": F.lit(1), "_f": F.lit(0)})
        .unionByName(found.select(*keys, "node").distinct().withColumns({"_t": F.lit(0), "_f": F.lit(1)}))
        .groupBy(*keys, "node").agg(F.max("_t").alias("_t"), F.max("_f").alias("_f"))
    )
    counts = sides.groupBy(*keys).agg(
        F.sum(F.col("_t") * F.col("_f")).alias("hit"), F.sum("_t").alias("truth"), F.sum("_f").alias("found")
    )
    precision = F.when(F.col("found") > 0, F.col("hit") / F.col("found")).otherwise(0.0)
    recall = F.when(F.col("truth") > 0, F.col("hit") / F.col("truth")).otherwise(0.0)
    scored = counts.withColumns({"precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    return scored.withColumn(
        "f_measure", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    ).select(*keys, "precision", "recall", "f_measure")


def walked_edges(edges: DataFrame, walked: DataFrame) -> DataFrame:
    """G10. Flags edges that were walked in either direction."""
    seen = canonical(walked).select(KEY, "src", "dst").distinct().withColumn("_w", F.lit(True))
    return canonical(edges).join(seen, [KEY, "src", "dst"], "left").withColumn("walked", F.col("_w").isNotNull()).drop("_w")


def project_vector(vector: DataFrame, support: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """G18. Entries of ``vector(keys, node, x)`` inside the support."""
    return vector.join(support.select(*keys, "node"), [*keys, "node"], "left_semi")


def detected_subgraph(found: DataFrame, edges: DataFrame) -> DataFrame:
    """G19. Edges among the nodes each method found in any fold.

    ``found(method, fold, node)``, ``edges(src, dst)``.
    """
    nodes = found.select("method", "node").distinct()
    start = edges.join(nodes.withColumnRenamed("node", "src"), "src")
    return start.join(nodes.withColumnRenamed("node", "dst"), ["method", "dst"]).select("method", "src", "dst")
