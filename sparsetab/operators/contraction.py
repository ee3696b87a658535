"""Messages on trees too large for a task, by raking leaves and compressing chains.

What an edge carries from one side to the other is ``x -> max(k, x + b)`` of what that side is worth: an edge of cost
``c`` has ``k = 0, b = -c``.  Such functions are closed under composition with a node between two edges, so a chain of
nodes becomes one edge with such a function each way.  A round rakes all leaves into their neighbours and takes out a
set of nodes with two neighbours of which no two are adjacent, chosen by hash; every round removes a constant share
of a tree, whatever its shape, so rounds follow the logarithm of its size.  A problem is contracted until it fits a
task, which solves what is left; then the rounds are undone in reverse order.  Sizes and costs are carried along: each
value is a struct ``(m, n, k, r)`` of worth, nodes, cost of their edges and whether the root is among them.

An edge function is a struct: ``km, kn, kk`` of its constant, ``bm, bn, bk`` that it adds when it passes ``x`` on, and
``r``, whether the root is among the nodes it stands for.  A side that holds the root passes whatever it is worth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparsetab.lineage import cut, cut_count
from sparsetab.operators import trees
from sparsetab.operators.trees import SLACK, by_problem, column, messages

KEY = "problem_id"
_VALUE = ("m", "n", "k", "r")
_FUNCTION = ("km", "kn", "kk", "bm", "bn", "bk", "r")


def edge_function(cost: Column, scaled: Column) -> Column:
    """Function of a plain edge: ``scaled`` is what it takes off a side's worth, ``cost`` what is counted as spent."""
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    return F.struct(*[v.alias(n) for n, v in zip(_FUNCTION, (zero, none, zero, -scaled, none, cost, F.lit(0)))])


def value(m: Column, n: Column, k: Column, r: Column) -> Column:
    return F.struct(m.cast("double").alias("m"), n.cast("long").alias("n"), k.cast("double").alias("k"), r.cast("int").alias("r"))


def _add(x: Column, y: Column, sign: int = 1) -> Column:
    return value(*[x[c] + sign * y[c] for c in _VALUE])


def _passed(f: Column, x: Column) -> Column:
    gain = x["m"] + f["bm"]
    passes = (x["r"] > 0) | (gain > f["km"] + SLACK * (F.abs(x["m"]) + F.abs(f["bm"])))
    return F.when(passes, value(gain, x["n"] + f["bn"], x["k"] + f["bk"], F.greatest(x["r"], f["r"]))).otherwise(
        value(f["km"], f["kn"], f["kk"], f["r"]))


def _composed(first: Column, node: Column, then: Column) -> Column:
    """``then`` of (``node`` plus ``first`` of x).

    With the root in the middle, what comes out of it always passes ``then``.
    """
    rooted = (first["r"] + node["r"]) > 0
    constant = _passed(then, value(first["km"] + node["m"], first["kn"] + node["n"], first["kk"] + node["k"], rooted.cast("int")))
    added = {"bm": first["bm"] + node["m"] + then["bm"], "bn": first["bn"] + node["n"] + then["bn"], "bk": first["bk"] + node["k"] + then["bk"]}
    parts = {"km": constant["m"], "kn": constant["n"], "kk": constant["k"], **added, "r": F.greatest(rooted.cast("int"), then["r"])}
    return F.struct(*[parts[n].alias(n) for n in _FUNCTION])


def _both_ways(edges: DataFrame) -> DataFrame:
    """``node, nbr`` with the functions away from and towards ``node``."""
    away = edges.select(KEY, F.col("a").alias("node"), F.col("b").alias("nbr"), F.col("ab").alias("out"), F.col("ba").alias("back"))
    return away.unionByName(edges.select(KEY, F.col("b").alias("node"), F.col("a").alias("nbr"), F.col("ba").alias("out"), F.col("ab").alias("back")))


def _contract(nodes: DataFrame, edges: DataFrame, number: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round: nodes and edges that stay, what was removed, and nodes without an edge, which are done."""
    around = _both_ways(edges)
    degrees = around.groupBy(KEY, "node").agg(F.count(F.lit(1)).alias("d"), F.min("nbr").alias("n1"), F.max("nbr").alias("n2"))
    degrees = cut(degrees)
    alone = nodes.join(degrees.select(KEY, "node"), [KEY, "node"], "left_anti")
    few = degrees.filter("d <= 2")
    rank = lambda c: F.xxhash64(F.lit(number), F.col(c))
    sides = few.select(KEY, "node", "d", "n1", "n2", F.explode(F.array_distinct(F.array("n1", "n2"))).alias("nbr"))
    beside = sides.join(few.select(KEY, F.col("node").alias("nbr"), F.col("d").alias("nd")), [KEY, "nbr"], "left")
    earlier = F.struct(rank("nbr"), F.col("nbr")) < F.struct(rank("node"), F.col("node"))
    # a leaf goes, of two leaves joined to each other the larger; a chain node goes if no leaf and no earlier chain node is beside it
    blocked = F.when(F.col("d") == 1, (F.col("nd") == 1) & (F.col("nbr") > F.col("node"))).otherwise((F.col("nd") == 1) | ((F.col("nd") == 2) & earlier))
    free = beside.groupBy(KEY, "node", "d", "n1", "n2").agg(F.bool_or(F.coalesce(blocked, F.lit(False))).alias("_blocked")).filter("not _blocked").drop("_blocked")
    ends = around.join(free, [KEY, "node"]).groupBy(KEY, "node", "d", "n1", "n2").agg(*[
        F.first(F.when(F.col("nbr") == F.col(n), F.col(f)), ignorenulls=True).alias(f"{f}{i}") for i, n in ((1, "n1"), (2, "n2")) for f in ("out", "back")])
    gone = cut(ends.join(nodes, [KEY, "node"]))

    arrived = gone.filter("d = 1").select(KEY, F.col("n1").alias("node"), _passed(F.col("out1"), F.col("own")).alias("x")).groupBy(KEY, "node").agg(
        value(*[F.sum(F.col(f"x.{c}")) for c in _VALUE]).alias("x"))
    stay = degrees.select(KEY, "node").join(gone.select(KEY, "node"), [KEY, "node"], "left_anti")
    left = nodes.join(stay, [KEY, "node"]).join(arrived, [KEY, "node"], "left").select(
        KEY, "node", F.when(F.col("x").isNull(), F.col("own")).otherwise(_add(F.col("own"), F.col("x"))).alias("own"))
    kept = edges
    for end in ("a", "b"):
        kept = kept.join(gone.select(KEY, F.col("node").alias(end)), [KEY, end], "left_anti")
    chained = gone.filter("d = 2").select(
        KEY, F.col("n1").alias("a"), F.col("n2").alias("b"),
        _composed(F.col("back1"), F.col("own"), F.col("out2")).alias("ab"), _composed(F.col("back2"), F.col("own"), F.col("out1")).alias("ba"))
    return left, kept.select(KEY, "a", "b", "ab", "ba").unionByName(chained), gone, alone


def _restore(payoffs: DataFrame, sent: DataFrame, gone: DataFrame, alone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undoes a round: payoffs of the removed nodes and messages of their edges."""
    leaves = gone.filter("d = 1").join(payoffs.select(KEY, F.col("node").alias("n1"), F.col("payoff").alias("_p")), [KEY, "n1"]).select(
        KEY, "node", "n1", "own", "back1", "_p", _passed(F.col("out1"), F.col("own")).alias("to")).select(
        KEY, "node", "n1", "own", "to", _passed(F.col("back1"), _add(F.col("_p"), F.col("to"), -1)).alias("from"))
    near = payoffs.select(KEY, F.col("node").alias("n1"), F.col("payoff").alias("_p1"))
    far = payoffs.select(KEY, F.col("node").alias("n2"), F.col("payoff").alias("_p2"))
    joint = sent.select(KEY, F.col("a").alias("n1"), F.col("b").alias("n2"), F.col("ab").alias("_ab"), F.col("ba").alias("_ba"))
    chains = gone.filter("d = 2").join(joint, [KEY, "n1", "n2"]).join(near, [KEY, "n1"]).join(far, [KEY, "n2"]).select(
        KEY, "node", "n1", "n2", "own", "out1", "out2",
        _passed(F.col("back1"), _add(F.col("_p1"), F.col("_ba"), -1)).alias("in1"), _passed(F.col("back2"), _add(F.col("_p2"), F.col("_ab"), -1)).alias("in2")).select(
        KEY, "node", "n1", "n2", "own", "in1", "in2", _passed(F.col("out1"), _add(F.col("own"), F.col("in2"))).alias("to1"),
        _passed(F.col("out2"), _add(F.col("own"), F.col("in1"))).alias("to2"))
    leaves, chains = cut(leaves), cut(chains)
    payoffs = payoffs.unionByName(alone.select(KEY, "node", F.col("own").alias("payoff"))).unionByName(leaves.select(KEY, "node", _add(F.col("own"), F.col("from")).alias("payoff"))).unionByName(
        chains.select(KEY, "node", _add(_add(F.col("own"), F.col("in1")), F.col("in2")).alias("payoff")))
    ends = [(leaves, "n1", "to", "from"), (chains, "n1", "to1", "in1"), (chains, "n2", "to2", "in2")]
    sent = sent.join(chains.select(KEY, F.col("n1").alias("a"), F.col("n2").alias("b")), [KEY, "a", "b"], "left_anti")
    for table, nbr, to, back in ends:
        up = F.col("node") < F.col(nbr)
        sent = sent.unionByName(table.select(
            KEY, F.least("node", nbr).alias("a"), F.greatest("node", nbr).alias("b"), F.when(up, F.col(to)).otherwise(F.col(back)).alias("ab"),
            F.when(up, F.col(back)).otherwise(F.col(to)).alias("ba")))
    return cut(payoffs), cut(sent)


_CORE = ("a long, b long, xm double, xn long, xk double, xr int, ym double, yn long, yk double, yr int")


def _core(table) -> dict[str, list]:
    """Payoffs (rows without ``b``) and messages (rows with both ends) of one problem."""
    b = table.column("b")
    is_edge = b.is_valid().to_numpy()
    rows = {c: column(table, c) for c in table.column_names if c not in (KEY, "b")}
    order = np.argsort(rows["a"][~is_edge], kind="stable")
    node = rows["a"][~is_edge][order]
    own = list(zip(*(rows[f"f{i}"][~is_edge][order].tolist() for i in range(4))))
    own = [(m, int(n), k, int(r)) for m, n, k, r in own]
    ends = [np.searchsorted(node, v).tolist() for v in (rows["a"][is_edge], b.drop_null().to_numpy())]
    ab, ba = ([(f[0], int(f[1]), f[2], f[3], int(f[4]), f[5], int(f[6])) for f in zip(*(rows[f"{s}{i}"][is_edge].tolist() for i in range(7)))] for s in "fg")
    worth, to, back = messages(own, ends[0], ends[1], ab, ba)
    names = [c.split()[0] for c in _CORE.split(", ")]
    empty = (0.0, 0, 0.0, 0)
    out = [(int(v), None, *w, *empty) for v, w in zip(node, worth)] + [(int(node[i]), int(node[j]), *x, *y) for i, j, x, y in zip(*ends, to, back)]
    kinds = [pa.int64(), pa.int64(), *[pa.float64(), pa.int64(), pa.float64(), pa.int32()] * 2]
    return {n: pa.array([row[i] for row in out], kinds[i]) for i, n in enumerate(names)}


def _solved(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payoffs and messages of problems that fit a task."""
    values = [F.col(f"own.{c}").cast("double").alias(f"f{i}") for i, c in enumerate(_VALUE)] + [F.lit(None).cast("double").alias(f"f{i}") for i in range(4, 7)]
    unused = [F.lit(None).cast("double").alias(f"g{i}") for i in range(7)]
    functions = [F.col(f"{s}.{c}").cast("double").alias(f"{t}{i}") for s, t in (("ab", "f"), ("ba", "g")) for i, c in enumerate(_FUNCTION)]
    rows = nodes.select(KEY, F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), *values, *unused).unionByName(edges.select(KEY, "a", "b", *functions))
    out = cut(by_problem(rows, KEY, _core, _CORE))
    four = lambda s: value(*[F.col(f"{s}{c}") for c in _VALUE])
    return (out.filter("b is null").select(KEY, F.col("a").alias("node"), four("x").alias("payoff")),
            out.filter("b is not null").select(KEY, "a", "b", four("x").alias("ab"), four("y").alias("ba")))


def tree_values(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Payoffs and messages of a forest of any size, and the number of rounds it took.

    ``nodes(problem_id, node, own)`` with a value each, ``edges(problem_id, a, b, ab, ba)`` with ``a < b`` and a function
    each way; both ends of an edge are nodes.  Returns ``(problem_id, node, payoff)``: the best subtree holding the
    node; and ``(problem_id, a, b, ab, ba)``: the message each way.
    """
    small, rounds, removed = [], 0, []
    left = 1
    while True:
        sizes, left = cut_count(nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")), f"2 * n > {trees.LIMIT}")
        if not left:
            small.append((nodes, edges))
            break
        big = sizes.filter(f"2 * n > {trees.LIMIT}").select(KEY)
        small.append((nodes.join(big, KEY, "left_anti"), edges.join(big, KEY, "left_anti")))
        nodes, edges, gone, alone = _contract(nodes.join(big, KEY, "left_semi"), edges.join(big, KEY, "left_semi"), rounds)
        nodes, edges = cut(nodes), cut(edges)
        removed.append((gone, cut(alone)))
        rounds += 1
    some, links = small[0]
    for n, e in small[1:]:
        some, links = some.unionByName(n), links.unionByName(e)
    payoffs, sent = _solved(some, links)
    for round_ in reversed(removed):
        payoffs, sent = _restore(payoffs, sent, *round_)
    return payoffs, sent, rounds
