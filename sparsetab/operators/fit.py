"""Sparse, graph-constrained and group-sparse model fitting.

Data is ``rows(problem_id, row_id, x array<double>, y)`` with ``row_id`` counted
from 0 within a problem.  A fit runs all ``jobs(problem_id, job_id, ...)`` at
once, for instance every learning rate of every problem.  Model state is one
row per job whose arrays hold the nonzero weights, at most ``s`` of them.

Two designs give the same gradients.  ``GramDesign`` reads the data once and
iterates on the Gram matrix (per block, if blocks are wanted).  ``RowDesign``
reads the rows in every step and serves any number of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparsetab.functions.scalar import dot, log_sigmoid, sigmoid, sparse_dot
from sparsetab.lineage import cut, cut_count
from sparsetab.operators import active, iterate
from sparsetab.operators.forest import size_band
from sparsetab.operators.matrix import MAX_GRAM_COLUMNS, chosen_block, gram, row_blocks, solve_normal, vector_sums
from sparsetab.operators.ranking import by_magnitude, top_k
from sparsetab.operators.relational import attach_row

P = "problem_id"
JOB = [P, "job_id"]
FULL = -1  # block number that stands for all rows
_TAIL = -2  # rows that fill no block

NO_IDX = "cast(array() as array<int>)"
NO_W = "cast(array() as array<double>)"


def with_blocks(rows: DataFrame, b: int | None) -> DataFrame:
    """Rows with their block number; all rows in block 0 when ``b`` is not given."""
    if b is None:
        return rows.withColumn("block", F.lit(0))
    total = rows.groupBy(P).agg(F.count(F.lit(1)).alias("_n"))
    placed = row_blocks(rows.join(total, P), F.col("_n"), F.lit(b))
    return placed.withColumn("block", F.coalesce("block", F.lit(_TAIL)).cast("int")).drop("_n")


@dataclass
class GramDesign:
    """Normal equations of every problem and block: ``(problem_id, block, i, g, xty)``."""

    table: DataFrame
    stats: DataFrame  # problem_id, n, yy, num_blocks, p

    @staticmethod
    def of(rows: DataFrame, b: int | None = None, centre: bool = False) -> "GramDesign":
        """One pass over the data. ``centre`` removes the means of columns and response."""
        wide = with_blocks(rows, b).select(P, "block", F.concat("x", F.array("y", F.lit(1.0))).alias("x"))
        parts = cut(gram(wide, [P, "block"]))
        whole = vector_sums(parts, [P, "i"], "sums").withColumn("block", F.lit(FULL))
        both = cut(parts.filter(F.col("block") >= 0).select(P, "block", "i", "sums").unionByName(whole.select(P, "block", "i", "sums")))
        p = F.size("sums") - 2
        if centre:
            means = both.filter(F.col("i") == p + 1).select(P, "block", F.transform("sums", lambda v: v / F.element_at("sums", -1)).alias("_m"))
            both = both.join(means, [P, "block"]).select(
                P, "block", "i",
                F.when(F.col("i") <= p, F.zip_with("sums", "_m", lambda v, m: v - m * F.element_at("sums", -1))).otherwise(F.col("sums")).alias("sums"),
            )
        table = both.filter(F.col("i") < p).select(P, "block", "i", F.slice("sums", 1, p).alias("g"), F.get("sums", p).alias("xty"))
        last = F.element_at("sums", -1)
        stats = both.filter(F.col("block") == FULL).groupBy(P).agg(
            F.max(F.when(F.col("i") == p, F.get("sums", p))).alias("yy"), F.max(F.when(F.col("i") == p + 1, last)).alias("n"),
            F.max_by("sums", "i").alias("totals"), F.max(p).alias("p"),
        )
        blocks = parts.filter(F.col("block") >= 0).groupBy(P).agg((F.max("block") + 1).alias("num_blocks"))
        return GramDesign(cut(table), cut(stats.join(blocks, P)))

    def gradient(self, state: DataFrame) -> DataFrame:
        """``X'(X w - y)`` of the state's block: ``(state keys, col_id, gradient)``."""
        joined = self.table.join(state.select(*JOB, "block", "idx", "w"), [P, "block"])
        return joined.select(*JOB, F.col("i").alias("col_id"), (sparse_dot(F.col("g"), F.col("idx"), F.col("w")) - F.col("xty")).alias("gradient"))

    def energy(self, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Squared norm of ``X v`` over all rows, for sparse ``vectors(keys, idx, w)``."""
        entry = vectors.withColumn("_z", F.arrays_zip("idx", "w")).select(*keys, "idx", "w", F.explode("_z").alias("_e")).select(*keys, "idx", "w", F.col("_e.idx").alias("i"), F.col("_e.w").alias("v"))
        rows = self.table.filter(F.col("block") == FULL).select(P, "i", "g")
        return entry.join(rows, [P, "i"]).groupBy(*keys).agg(F.sum(F.col("v") * sparse_dot(F.col("g"), F.col("idx"), F.col("w"))).alias("energy"))

    def residual(self, state: DataFrame) -> DataFrame:
        """Squared norm of ``y - X w`` over all rows; limited to the precision of the Gram form.

        What rounding leaves below 0 counts by its size, so it does not pass for a
        perfect fit.
        """
        entry = state.withColumn("_z", F.arrays_zip("idx", "w")).select(*JOB, "idx", "w", F.explode("_z").alias("_e")).select(*JOB, "idx", "w", F.col("_e.idx").alias("i"), F.col("_e.w").alias("v"))
        rows = self.table.filter(F.col("block") == FULL).select(P, "i", "g", "xty")
        change = entry.join(rows, [P, "i"]).groupBy(*JOB).agg(
            F.sum(F.col("v") * (sparse_dot(F.col("g"), F.col("idx"), F.col("w")) - 2 * F.col("xty"))).alias("_c"))
        base = state.select(*JOB).join(self.stats.select(P, "yy"), P).join(change, JOB, "left")
        return base.select(*JOB, F.abs(F.col("yy") + F.coalesce("_c", F.lit(0.0))).alias("rss"))

    def normal_on(self, supports: DataFrame) -> DataFrame:
        """Normal equations limited to ``supports(keys, idx)``, one row per kept column."""
        rows = self.table.filter(F.col("block") == FULL).select(P, "i", "g", "xty")
        entry = supports.select(*JOB, F.array_sort("idx").alias("_s"), F.explode("idx").alias("i"))
        return entry.join(rows, [P, "i"]).select(*JOB, F.col("i").alias("idx"), F.transform("_s", lambda c: F.get(F.col("g"), c)).alias("g"), "xty")


@dataclass
class RowDesign:
    """The rows themselves, with their block: ``(problem_id, block, x, y)``."""

    rows: DataFrame
    stats: DataFrame

    @staticmethod
    def of(rows: DataFrame, b: int | None = None) -> "RowDesign":
        placed = with_blocks(rows, b)
        stats = placed.groupBy(P).agg(
            F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).cast("double").alias("n"),
            (F.max("block") + 1).alias("num_blocks"), F.max(F.size("x")).alias("p"),
        )
        return RowDesign(placed, cut(stats))

    def with_state(self, state: DataFrame, *columns: str) -> DataFrame:
        mine = state.select(*JOB, F.col("block").alias("_b"), *columns)
        return self.rows.join(mine, P).filter((F.col("_b") == FULL) | (F.col("_b") == F.col("block"))).drop("_b")

    def gradient(self, state: DataFrame) -> DataFrame:
        joined = self.with_state(state, "idx", "w")
        gap = sparse_dot(F.col("x"), F.col("idx"), F.col("w")) - F.col("y")
        return vector_sums(joined, JOB, "x", gap).select(*JOB, F.posexplode("sums").alias("col_id", "gradient"))

    def energy(self, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
        value = sparse_dot(F.col("x"), F.col("idx"), F.col("w"))
        return self.rows.join(vectors, P).groupBy(*keys).agg(F.sum(value * value).alias("energy"))

    def residual(self, state: DataFrame) -> DataFrame:
        gap = F.col("y") - sparse_dot(F.col("x"), F.col("idx"), F.col("w"))
        return self.rows.join(state.select(*JOB, "idx", "w"), P).groupBy(*JOB).agg(F.sum(gap * gap).alias("rss"))

    def normal_on(self, supports: DataFrame) -> DataFrame:
        kept = self.rows.join(supports.select(*JOB, F.array_sort("idx").alias("_s")), P).select(
            *JOB, F.concat(F.transform("_s", lambda c: F.get(F.col("x"), c)), F.array("y")).alias("x"))
        size = F.size("sums") - 1
        rows = gram(kept, JOB).filter(F.col("i") < size)
        return rows.join(supports.select(*JOB, F.array_sort("idx").alias("_s")), JOB).select(
            *JOB, F.get("_s", F.col("i")).alias("idx"), F.slice("sums", 1, size).alias("g"), F.get("sums", size).alias("xty"))


# -- state ---------------------------------------------------------------------

def _start(jobs: DataFrame, graph: "Graph | None" = None) -> DataFrame:
    if graph is not None:
        jobs = jobs.withColumn("in_band", F.lit(True))
    return jobs.withColumns({
        "idx": F.expr(NO_IDX), "w": F.expr(NO_W), "block": F.lit(FULL), "epochs": F.lit(0),
        "rss": F.lit(None).cast("double"), "done": F.lit(False), "converged": F.lit(False),
    })


def _arrays(entries: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Nonzero ``(keys, col_id, value)`` as one row of arrays per key, in column order."""
    packed = entries.filter(F.col(value) != 0).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("col_id").cast("int").alias("i"), F.col(value).alias("v")))).alias("_e"))
    return packed.select(*keys, F.col("_e.i").alias("idx"), F.col("_e.v").alias("w"))


def _replace(state: DataFrame, arrays: DataFrame) -> DataFrame:
    rest = [c for c in state.columns if c not in ("idx", "w")]
    return state.select(*rest).join(arrays, JOB, "left").select(
        *rest, F.coalesce("idx", F.expr(NO_IDX)).alias("idx"), F.coalesce("w", F.expr(NO_W)).alias("w"))


def _weight_at(column: str = "col_id") -> Column:
    position = F.array_position("idx", F.col(column).cast("int")).cast("int")
    return F.coalesce(F.get("w", position - 1), F.lit(0.0))


def _apart() -> Column:
    """Largest difference of a weight from its old value."""
    both = F.map_zip_with(F.map_from_arrays("idx", "w"), F.map_from_arrays("old_idx", "old_w"),
                          lambda i, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))
    return F.aggregate(F.map_values(both), F.lit(0.0), lambda a, v: F.greatest(a, v))


def _most() -> Column:
    return F.aggregate("w", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))


def _checked(design, state: DataFrame, tol: float) -> DataFrame:
    """Stop rules: weights diverge, the residual is within ``tol``, or no weight moves by more than its share ``tol`` of the largest."""
    size = F.aggregate("w", F.lit(0.0), lambda a, v: a + v * v)
    judged = state.drop("rss").join(design.residual(state), JOB)
    converged = (F.sqrt(size) < 1e3) & ((F.sqrt("rss") <= tol) | (_apart() <= tol * _most()))
    return judged.withColumns({
        "epochs": F.col("epochs") + 1, "converged": converged, "done": (F.sqrt(size) >= 1e3) | converged,
    })


def _run(design, state: DataFrame, max_epochs: int, tol: float, epoch_step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    columns = state.columns
    finished = []
    live = cut(state)
    for epoch in range(max_epochs):
        moved = epoch_step(live, epoch).join(live.select(*JOB, F.col("idx").alias("old_idx"), F.col("w").alias("old_w")), JOB)
        live, left = cut_count(_checked(design, moved, tol).select(*columns), "not done")
        finished.append(live.filter("done"))
        live = live.filter("not done")
        if not left:
            break
    result = live
    for part in finished:
        result = result.unionByName(part)
    return result


def weights_of(fitted: DataFrame, keys: Sequence[str] = JOB) -> DataFrame:
    """Fitted weights in long form ``(keys, col_id, w)``."""
    return fitted.select(*keys, F.explode(F.arrays_zip("idx", "w")).alias("_e")).select(
        *keys, F.col("_e.idx").alias("col_id"), F.col("_e.w").alias("w"))


# -- projections -----------------------------------------------------------------

def _graph_band(vector: DataFrame, value: str, edges: DataFrame, low: int, high: int, g: int, root: int | None, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Entries of ``vector(job keys, col_id, value)`` on a connected support of ``low..high`` nodes, and the jobs' ``in_band``."""
    key = F.struct(*JOB)
    nodes = vector.select(key.alias(P), F.col("col_id").cast("long").alias("node"), (F.col(value) * F.col(value)).alias("prize"))
    links = edges.join(vector.select(*JOB).distinct(), P).select(key.alias(P), "src", "dst", "cost")
    support = size_band(links, nodes, low, high, g, root, rounds)
    chosen = support.select(F.col(f"{P}.{P}").alias(P), F.col(f"{P}.job_id").alias("job_id"), F.col("node").cast("int").alias("col_id"), "in_band")
    return vector.join(chosen, [*JOB, "col_id"], "left_semi"), chosen.groupBy(*JOB).agg(F.min("in_band").alias("_met"))


def _held(state: DataFrame, *met: DataFrame) -> DataFrame:
    """``in_band`` of each job stays true as long as every support chosen for it met its band."""
    for each in met:
        state = state.join(each, JOB, "left").withColumn("in_band", F.col("in_band") & F.coalesce("_met", F.lit(False))).drop("_met")
    return state


@dataclass
class Graph:
    """Graph constraint: ``edges(problem_id, src, dst, cost)`` over column numbers."""

    edges: DataFrame
    gamma: float = 0.1
    g: int = 1
    root: int | None = None
    rounds: int = 1000


def _in_task(design, p: int | None, blocks: int | None, graph: Graph | None = None) -> bool:
    """Whether the normal equations of every problem, and its graph, fit a task."""
    return isinstance(design, GramDesign) and bool(p) and iterate.fits(p, blocks or 1) and (graph is None or not iterate.oversized_graph(graph.edges))


# -- regression --------------------------------------------------------------------

def iht(design, jobs: DataFrame, s: int, max_epochs: int = 500, tol: float = 1e-6, stochastic: bool = False,
        seed: int = 0, graph: Graph | None = None) -> DataFrame:
    """L4-L7. Iterative hard thresholding, on all rows or on drawn row blocks.

    ``jobs(problem_id, job_id, lr)``.  The full gradient has factor 1, the block
    gradient factor 2.  With a graph, the gradient is first limited to a head
    support of ``p/2`` nodes and the step to a tail support of ``s`` nodes;
    otherwise the ``s`` largest weights stay.  Returns the state of every job:
    ``idx, w, epochs, rss, done`` and ``converged`` (the residual is within ``tol``,
    or weights stand still), with a graph also ``in_band``: whether every support
    had a size in its band.  Designs that fit a task take all their steps there;
    drawn blocks of which one fits pass through it.
    """
    blocks, p = design.stats.agg(F.max("num_blocks"), F.max("p")).first() or (1, 0)
    if _in_task(design, p, blocks, graph):
        return iterate.run_jobs(design, jobs, iterate.hard_thresholding, max_epochs, tol, graph, s=s, stochastic=stochastic, seed=seed)
    if stochastic and _in_task(design, p, 1, graph):
        return iterate.run_drawn(design, jobs, s, max_epochs, tol, seed, graph)
    scale = 2.0 if stochastic else 1.0

    def step(state: DataFrame, epoch: int, number: int) -> DataFrame:
        if stochastic:
            drawn = chosen_block(seed, F.lit(epoch), F.lit(number), F.col("num_blocks"), *JOB).cast("int")
            state = state.drop("block").join(design.stats.select(P, "num_blocks"), P)
            idle = state.filter(F.col("num_blocks") <= number).drop("num_blocks").withColumn("block", F.lit(FULL))
            state = state.filter(F.col("num_blocks") > number).withColumn("block", drawn).drop("num_blocks")
        gradient = design.gradient(state)
        if graph is not None:
            gradient = cut(gradient)
            head = p // 2
            gradient, head_met = _graph_band(gradient, "gradient", graph.edges, head, int(head * (1 + graph.gamma)), graph.g, graph.root, graph.rounds)
            old = weights_of(state).select(*JOB, "col_id", "w")
            moves = gradient.join(state.select(*JOB, "lr"), JOB).select(*JOB, "col_id", (-scale * F.col("lr") * F.col("gradient")).alias("w"))
            target = cut(old.unionByName(moves).groupBy(*JOB, "col_id").agg(F.sum("w").alias("b")))
            kept, tail_met = _graph_band(_all_columns(target, p), "b", graph.edges, s, int(s * (1 + graph.gamma)), graph.g, graph.root, graph.rounds)
        else:
            target = gradient.join(state.select(*JOB, "lr", "idx", "w"), JOB).select(
                *JOB, "col_id", (_weight_at() - scale * F.col("lr") * F.col("gradient")).alias("b"))
            kept = top_k(target, JOB, by_magnitude("b", "col_id"), s)
        moved = _replace(state, _arrays(kept, JOB, "b"))
        if graph is not None:
            moved = _held(moved, head_met, tail_met)
        return moved.unionByName(idle.select(*moved.columns)) if stochastic else moved

    def epoch_step(state: DataFrame, epoch: int) -> DataFrame:
        for number in range(blocks if stochastic else 1):
            state = step(state, epoch, number)
            if stochastic:
                state = cut(state)
        return state

    return _run(design, _start(jobs, graph), max_epochs, tol, epoch_step)


def _all_columns(vector: DataFrame, p: int) -> DataFrame:
    """The vector with explicit zeros, as the graph needs a prize for every node."""
    keys = vector.select(*JOB).distinct()
    every = keys.withColumn("col_id", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).withColumn("b", F.lit(0.0))
    return vector.select(*JOB, F.col("col_id").cast("int").alias("col_id"), "b").unionByName(every).groupBy(*JOB, "col_id").agg(F.sum("b").alias("b"))


def niht(design, jobs: DataFrame, s: int, max_epochs: int = 500, tol: float = 1e-6) -> DataFrame:
    """L8. Hard thresholding with a step size taken from the current support.

    The step is ``|g|^2 / |X g|^2`` on the support; if the support changes, it is
    shrunk until it is short enough for the move made.  All shrunken steps of an
    epoch are scored in one pass.
    """
    blocks, p = design.stats.agg(F.max("num_blocks"), F.max("p")).first() or (1, 0)
    if _in_task(design, p, blocks):
        return iterate.run_jobs(design, jobs, iterate.normalised, max_epochs, tol, s=s)
    shrink = iterate.NIHT_KAPPA * (1.0 - iterate.NIHT_C)
    first = _start(jobs)
    top = top_k(design.gradient(first), JOB, by_magnitude("gradient", "col_id"), s)
    gamma = _arrays(top, JOB, "gradient").select(*JOB, F.col("idx").alias("gamma"))
    state = first.join(gamma, JOB, "left").withColumn("gamma", F.coalesce("gamma", F.expr(NO_IDX)))
    trial = [*JOB, "k"]

    def tried(down: DataFrame, tries: Sequence[int]) -> DataFrame:
        """Candidates for each number of shrinks, with the squared length of the move and of its image."""
        points = down.withColumn("k", F.explode(F.array(*[F.lit(k) for k in tries]))).select(
            *trial, "col_id", (_weight_at() + F.col("mu") * F.pow(F.lit(shrink), -F.col("k")) * F.col("down")).alias("b"))
        arrays = cut(_arrays(top_k(points, trial, by_magnitude("b", "col_id"), s), trial, "b"))
        old = down.select(*JOB, "idx", "w").distinct()
        moves = (
            arrays.select(*trial, F.explode(F.arrays_zip("idx", "w")).alias("_e")).select(*trial, F.col("_e.idx").alias("col_id"), F.col("_e.w").alias("d"))
            .unionByName(
                arrays.select(*trial).join(old, JOB).select(*trial, F.explode(F.arrays_zip("idx", "w")).alias("_e"))
                .select(*trial, F.col("_e.idx").alias("col_id"), (-F.col("_e.w")).alias("d")))
            .groupBy(*trial, "col_id").agg(F.sum("d").alias("d")).filter("d <> 0")
        )
        length = moves.groupBy(*trial).agg(F.sum(F.col("d") * F.col("d")).alias("xx"))
        image = design.energy(_arrays(moves, trial, "d"), trial)
        return arrays.join(length, trial, "left").join(image, trial, "left").fillna(0.0, ["xx", "energy"])

    def epoch_step(state: DataFrame, epoch: int) -> DataFrame:
        gradient = cut(design.gradient(state).select(*JOB, "col_id", (-F.col("gradient")).alias("down")))
        on = _arrays(
            gradient.join(state.select(*JOB, "gamma"), JOB).filter(F.array_contains("gamma", F.col("col_id").cast("int"))), JOB, "down")
        size = on.select(*JOB, F.aggregate("w", F.lit(0.0), lambda a, v: a + v * v).alias("_xx"))
        mu = size.join(design.energy(on, JOB), JOB).select(
            *JOB, F.when(F.col("energy") > 0, F.col("_xx") / F.nullif(F.col("energy"), F.lit(0.0))).otherwise(1.0).alias("mu"))
        full = cut(gradient.join(state.select(*JOB, "idx", "w"), JOB).join(mu, JOB, "left").fillna(1.0, ["mu"]))
        first_try = cut(
            tried(full, [0]).withColumnsRenamed({"idx": "new_idx", "w": "new_w"})
            .join(state.select(*JOB, "gamma"), JOB).join(full.select(*JOB, "mu").distinct(), JOB)
            .withColumn("same", F.col("new_idx") == F.array_sort("gamma"))
            .withColumn("ok", F.col("same") | ((F.col("energy") > 0) & (F.col("mu") * F.col("energy") <= (1 - iterate.NIHT_C) * F.col("xx"))))
            .withColumn("stay", ~F.col("same") & (F.col("energy") <= 0))
        )
        again = first_try.filter("not ok and not stay").select(*JOB)
        more = tried(full.join(again, JOB, "left_semi"), range(1, iterate.NIHT_TRIES)).join(full.select(*JOB, "mu").distinct(), JOB)
        good = (F.col("energy") <= 0) | (F.col("mu") * F.pow(F.lit(shrink), -F.col("k")) * F.col("energy") <= (1 - iterate.NIHT_C) * F.col("xx"))
        best = more.filter(good).groupBy(*JOB).agg(F.min_by(F.struct("idx", "w"), "k").alias("_m"))
        chosen = (
            first_try.filter("ok and not stay").select(*JOB, F.col("new_idx").alias("_i"), F.col("new_w").alias("_w"), F.col("gamma").alias("_g"))
            .unionByName(best.select(*JOB, F.col("_m.idx").alias("_i"), F.col("_m.w").alias("_w"), F.col("_m.idx").alias("_g")))
        )
        rest = [c for c in state.columns if c not in ("idx", "w", "gamma")]
        return state.join(chosen, JOB, "left").select(
            *rest, F.coalesce("_i", "idx").alias("idx"), F.coalesce("_w", "w").alias("w"), F.coalesce("_g", "gamma").alias("gamma"))

    return _run(design, state, max_epochs, tol, epoch_step).drop("gamma")


def cosamp(design, jobs: DataFrame, s: int, max_epochs: int = 500, tol: float = 1e-6, graph: Graph | None = None) -> DataFrame:
    """L9, L10. Pursuit: least squares on the old support and 2s new columns, then s are kept.

    With a graph the new columns are a head support of ``2s`` nodes and the kept
    ones a tail support of ``s`` nodes; ``in_band`` tells whether every support had a
    size in its band.
    """
    blocks, p = design.stats.agg(F.max("num_blocks"), F.max("p")).first() or (1, 0)
    p = p or 0
    if _in_task(design, p, blocks, graph):
        return iterate.run_jobs(design, jobs, iterate.pursuit, max_epochs, tol, graph, s=s)

    def epoch_step(state: DataFrame, epoch: int) -> DataFrame:
        gradient = design.gradient(state)
        if graph is None:
            found = top_k(gradient, JOB, by_magnitude("gradient", "col_id"), 2 * s)
        else:
            found, head_met = _graph_band(cut(gradient), "gradient", graph.edges, 2 * s, int(2 * s * (1 + graph.gamma)), graph.g, graph.root, graph.rounds)
        new = found.groupBy(*JOB).agg(F.collect_set(F.col("col_id").cast("int")).alias("_n"))
        union = state.select(*JOB, "idx").join(new, JOB, "left").select(*JOB, F.array_union("idx", F.coalesce("_n", F.expr(NO_IDX))).alias("idx"))
        solved = solve_normal(design.normal_on(union), JOB).select(*JOB, F.col("idx").alias("col_id"), F.col("w").alias("b"))
        if graph is None:
            kept = top_k(solved, JOB, by_magnitude("b", "col_id"), s)
        else:
            kept, tail_met = _graph_band(_all_columns(cut(solved), p), "b", graph.edges, s, int(s * (1 + graph.gamma)), graph.g, graph.root, graph.rounds)
        moved = _replace(state, _arrays(kept, JOB, "b"))
        return moved if graph is None else _held(moved, head_met, tail_met)

    return _run(design, _start(jobs, graph), max_epochs, tol, epoch_step)


# -- losses ------------------------------------------------------------------------

def loss_terms(loss: str, y: Column, margin: Column, cp: Column | float = 1.0, cn: Column | float = 1.0) -> tuple[Column, Column, Column]:
    """L1-L3. Per-row loss, slope and curvature with respect to the margin."""
    if loss == "squared":
        gap = margin - y
        return gap * gap, 2 * gap, F.lit(2.0)
    share = F.lit(1.0) if loss == "logistic" else F.when(y > 0, cp).otherwise(cn)
    value = -log_sigmoid(y * margin)
    back = sigmoid(-y * margin)
    return share * value, -share * y * back, share * back * (1 - back)


def class_shares(rows: DataFrame) -> DataFrame:
    return rows.groupBy(P).agg(
        F.avg(F.when(F.col("y") < 0, 1.0).otherwise(0.0)).alias("cp"), F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0)).alias("cn"))


def loss_and_gradient(rows: DataFrame, weights: DataFrame, loss: str, curvature: bool = False, l2: float = 0.0, total: bool = False) -> DataFrame:
    """L1-L3. Loss, gradient and diagonal Hessian at given weights, by column.

    ``weights(problem_id, w array<double>, c)``.  Returns ``(problem_id, col_id,
    loss, gradient[, hessian])``; the intercept has ``col_id = -1``.  Means over
    the rows, or sums with ``total``.
    """
    joined = rows.join(weights, P)
    if loss == "balanced":
        joined = joined.join(class_shares(rows), P)
    value, slope, bend = loss_terms(loss, F.col("y"), dot(F.col("x"), F.col("w")) + F.col("c"), F.col("cp") if loss == "balanced" else 1.0, F.col("cn") if loss == "balanced" else 1.0)
    scored = joined.select(P, "x", value.alias("value"), slope.alias("slope"), bend.alias("bend"))
    totals = scored.groupBy(P).agg(F.sum("value").alias("loss"), F.count(F.lit(1)).alias("n"), F.sum("slope").alias("gc"), F.sum("bend").alias("hc"))
    norm = F.lit(1.0) if total else F.col("n")
    reg = 0.5 * l2 * F.aggregate("w", F.lit(0.0), lambda a, v: a + v * v)
    totals = totals.join(weights, P).select(P, (F.col("loss") / norm + reg).alias("loss"), norm.alias("norm"), (F.col("gc") / norm).alias("gc"), (F.col("hc") / norm).alias("hc"), "w")
    first = vector_sums(scored, [P], "x", F.col("slope")).select(P, F.posexplode("sums").alias("col_id", "_g"))
    columns = first.join(totals, P).select(P, "col_id", "loss", (F.col("_g") / F.col("norm") + l2 * F.get("w", F.col("col_id"))).alias("gradient"), "norm")
    intercept = totals.select(P, F.lit(-1).alias("col_id"), "loss", F.col("gc").alias("gradient"))
    if not curvature:
        return columns.drop("norm").unionByName(intercept)
    squares = scored.select(P, F.transform("x", lambda v: v * v).alias("x"), "bend")
    second = vector_sums(squares, [P], "x", F.col("bend")).select(P, F.posexplode("sums").alias("col_id", "_h"))
    both = columns.join(second, [P, "col_id"]).select(P, "col_id", "loss", "gradient", (F.col("_h") / F.col("norm") + l2).alias("hessian"))
    return both.unionByName(totals.select(P, F.lit(-1).alias("col_id"), "loss", F.col("gc").alias("gradient"), F.col("hc").alias("hessian")))


# -- balanced classification ---------------------------------------------------------

def _dense(p: int) -> Column:
    """Dense array from the sparse arrays of a state."""
    return F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.coalesce(F.get("w", F.array_position("idx", i).cast("int") - 1), F.lit(0.0)))


def balanced_iht(rows: DataFrame, jobs: DataFrame, s: int, max_epochs: int = 500, num_blocks: int = 1, seed: int = 0,
                 graph: Graph | None = None, sum_intercept: bool = False, tol: float = 1e-6) -> DataFrame:
    """L11, L12. Sparse class-balanced logistic regression with a step search.

    ``jobs(problem_id, job_id, lam)``.  A step starts at 1 and is multiplied by
    0.8 until the loss falls enough, at most 20 times; all step sizes are scored
    in one pass over the block.  The intercept takes no part in the choice of
    the ``s`` columns.  ``sum_intercept`` leaves its gradient a sum over rows.
    With a graph, ``in_band`` tells whether every support had a size in its band;
    ``converged`` tells whether an epoch moved no weight by more than its share
    ``tol`` of the largest.  Problems whose rows fit a task are fitted there.
    """
    size_of = rows.groupBy(P).agg((F.count(F.lit(1)) * F.max(F.size("x"))).alias("_n"))
    if size_of.filter(F.col("_n") > iterate.ROWS * iterate.LIMIT).isEmpty() and (graph is None or not iterate.oversized_graph(graph.edges)):
        return iterate.run_balanced(rows, jobs, s, max_epochs, tol, num_blocks, seed, sum_intercept, graph)
    total = rows.groupBy(P).agg(F.count(F.lit(1)).alias("_n"))
    size = F.floor(F.col("_n") / num_blocks)
    place = F.floor(F.col("row_id") / size)
    placed = rows.join(total, P).withColumn("block", F.when(place < num_blocks, place).otherwise(_TAIL).cast("int")).drop("_n")
    shares = cut(class_shares(rows))
    p = rows.select(F.max(F.size("x"))).first()[0]
    state = cut(_start(jobs, graph).drop("rss", "done").withColumn("c", F.lit(0.0)).join(shares, P))
    names, finished = state.columns, []
    for epoch in range(max_epochs):
        began = state.select(*JOB, F.col("idx").alias("old_idx"), F.col("w").alias("old_w"), F.col("c").alias("old_c"))
        for number in range(num_blocks):
            drawn = chosen_block(seed, F.lit(epoch), F.lit(number), F.lit(num_blocks), *JOB).cast("int")
            state = state.withColumn("block", drawn if num_blocks > 1 else F.lit(0))
            joined = placed.join(state.select(*JOB, "block", "idx", "w", "c", "cp", "cn"), [P, "block"])
            margin = sparse_dot(F.col("x"), F.col("idx"), F.col("w")) + F.col("c")
            value, slope, _ = loss_terms("balanced", F.col("y"), margin, F.col("cp"), F.col("cn"))
            scored = joined.select(*JOB, "x", value.alias("value"), slope.alias("slope"))
            sums = scored.groupBy(*JOB).agg(F.sum("value").alias("_loss"), F.sum("slope").alias("_gc"), F.count(F.lit(1)).alias("_n"))
            vector = vector_sums(scored, JOB, "x", F.col("slope"))
            dense = vector.join(sums, JOB).join(state, JOB).select(
                *names, "_loss", "_n", _dense(p).alias("_w"), "sums",
                (F.col("_gc") / (F.lit(1.0) if sum_intercept else F.col("_n"))).alias("_gc"))
            ready = cut(dense.withColumn("_g", F.zip_with("sums", F.transform("_w", lambda v: v * F.col("lam")), lambda a, b: a / F.col("_n") + b)).drop("sums"))
            if graph is not None:
                head = p // 2
                long = ready.select(*JOB, F.posexplode("_g").alias("col_id", "gradient"))
                limited, head_met = _graph_band(long, "gradient", graph.edges, head, int(head * (1 + graph.gamma)), graph.g, graph.root, graph.rounds)
                packed = _arrays(limited, JOB, "gradient").withColumnsRenamed({"idx": "_hi", "w": "_hw"})
                at = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.coalesce(F.get("_hw", F.array_position("_hi", i).cast("int") - 1), F.lit(0.0)))
                ready = cut(ready.drop("_g").join(packed, JOB, "left").withColumn("_g", F.coalesce(at, F.array_repeat(F.lit(0.0), p))).drop("_hi", "_hw"))
            square = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v * v)
            reg = square("_g") + F.col("_gc") * F.col("_gc")
            start = F.col("_loss") / F.col("_n") + 0.5 * F.col("lam") * square("_w")
            ahead = placed.join(ready.select(*JOB, "block", "idx", "w", "c", "cp", "cn", "_g", "_gc"), [P, "block"]).select(
                *JOB, "y", "cp", "cn", (sparse_dot(F.col("x"), F.col("idx"), F.col("w")) + F.col("c")).alias("m"), (dot(F.col("x"), F.col("_g")) + F.col("_gc")).alias("mg"))
            tries = F.sequence(F.lit(0), F.lit(iterate.STEP_TRIES - 1))
            stepped = ahead.withColumn("t", F.explode(tries))
            step_at = F.pow(F.lit(iterate.BETA), F.col("t"))
            cost = loss_terms("balanced", F.col("y"), F.col("m") - step_at * F.col("mg"), F.col("cp"), F.col("cn"))[0]
            losses = stepped.groupBy(*JOB, "t").agg(F.sum(cost).alias("_left"))
            moved_w = F.zip_with("_w", "_g", lambda a, b: a - step_at * b)
            judged = losses.join(ready, JOB).withColumn(
                "_good", F.col("_left") / F.col("_n") + 0.5 * F.col("lam") * square(moved_w) <= start - step_at / 2 * reg)
            best = judged.groupBy(*JOB).agg(F.coalesce(F.min(F.when(F.col("_good"), F.col("t"))), F.lit(iterate.STEP_TRIES)).alias("t"))
            moved = ready.join(best, JOB)
            target = moved.select(*JOB, F.posexplode(F.zip_with("_w", "_g", lambda a, b: a - step_at * b)).alias("col_id", "b"))
            if graph is None:
                kept = top_k(target, JOB, by_magnitude("b", "col_id"), s)
            else:
                kept, tail_met = _graph_band(cut(target), "b", graph.edges, s, int(s * (1 + graph.gamma)), graph.g, graph.root, graph.rounds)
            replaced = _replace(moved.withColumn("c", F.col("c") - step_at * F.col("_gc")).select(*names), _arrays(kept, JOB, "b"))
            state = cut((replaced if graph is None else _held(replaced, head_met, tail_met)).select(*names))
        slid = F.abs(F.col("c") - F.col("old_c")) <= tol * F.greatest(F.lit(1.0), F.abs("c"))
        state, left = cut_count(state.join(began, JOB).withColumns(
            {"epochs": F.lit(epoch + 1), "converged": slid & (_apart() <= tol * _most())}).select(*names), "not converged")
        finished.append(state.filter("converged"))
        state = state.filter("not converged")
        if not left:
            break
    for part in finished:
        state = state.unionByName(part)
    return state.drop("block", "cp", "cn")


# -- group lasso ------------------------------------------------------------------------

def _step_size(bound: DataFrame, groups: DataFrame, factor: float) -> DataFrame:
    """Step per problem from ``bound(problem_id, top, n)``, ``top`` bounding the curvature of ``|X w|^2``.

    A column copied into several groups multiplies the curvature by its copies.
    """
    copies = groups.groupBy("col_id").agg(F.count(F.lit(1)).alias("copies")).agg(F.max("copies").alias("copies"))
    return attach_row(bound, copies).select(P, (F.col("n") / (factor * F.col("top") * F.col("copies"))).alias("step"), "n")


def _gram_bound(design: GramDesign) -> DataFrame:
    """Largest absolute row sum of the Gram matrix."""
    rowsum = F.aggregate("g", F.lit(0.0), lambda a, v: a + F.abs(v))
    top = design.table.filter(F.col("block") == FULL).groupBy(P).agg(F.max(rowsum).alias("top"))
    return top.join(design.stats.select(P, "n"), P)


def _row_bound(rows: DataFrame) -> DataFrame:
    """The same bound from the rows: by the Gram matrix, or its trace if it would be too wide."""
    if (rows.select(F.max(F.size("x"))).first()[0] or 0) < MAX_GRAM_COLUMNS - 2:
        return _gram_bound(GramDesign.of(rows))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    return rows.groupBy(P).agg(F.sum(square).alias("top"), F.count(F.lit(1)).cast("double").alias("n"))


def group_lasso(design: GramDesign, jobs: DataFrame, groups: DataFrame, max_iter: int = 200, tol: float = 1e-7, chain: int = 5) -> DataFrame:
    """L13, L15. Group lasso with squared loss, for disjoint or overlapping groups.

    Minimises ``|y - X w|^2 / n + lam * sum(weight * |w_group|)``, a column in
    several groups having one latent weight in each.  ``jobs(problem_id, job_id,
    lam)`` holds the whole path: the problem is convex, so every lambda is fitted
    side by side.  ``groups(group_id, col_id[, weight])``; singleton groups give
    the lasso.  Accelerated proximal gradient steps run on the Gram matrix,
    ``chain`` of them in one job.  Returns ``entries`` (latent weights ``w`` and
    the point ``z`` the next step starts from), ``change``, and ``converged``: the
    last step moved no weight by more than ``tol``.  Gram matrices that fit a task
    are solved there by block coordinate steps, up to 50 sweeps for each of
    ``max_iter``.
    """
    if "weight" not in groups.columns:
        groups = groups.withColumn("weight", F.lit(1.0))
    if _in_task(design, design.stats.agg(F.max("p")).first()[0], 1):
        return active.gram_group_lasso(design, jobs, groups, 50 * max_iter, tol)
    owners = groups.groupBy(F.col("col_id").cast("int").alias("i")).agg(F.collect_list(F.struct("group_id", "weight")).alias("owners"))
    steps = cut(_step_size(_gram_bound(design), groups, 2.0))
    table = cut(design.table.filter(F.col("block") == FULL).drop("block").join(owners, "i").join(steps, P))
    kind = groups.schema["group_id"].dataType.simpleString()
    none = F.expr(f"cast(array() as array<struct<group_id:{kind},col_id:int,w:double,z:double>>)")
    jobs = cut(jobs.select(*JOB, "lam"))
    state = jobs.withColumns({"entries": none, "change": F.lit(None).cast("double")})
    for turn in range(max_iter // chain):
        for inner in range(chain):
            number = turn * chain + inner
            state = _proximal(table, jobs, state, none, number / (number + 3.0))
        state, left = cut_count(state, f"change > {tol}")
        if not left:
            break
    return state.withColumn("converged", F.coalesce(F.col("change") <= tol, F.lit(False)))


def _proximal(table: DataFrame, jobs: DataFrame, state: DataFrame, none: Column, momentum: float) -> DataFrame:
    e = F.col("entries")
    gradient = (sparse_dot(F.col("g"), e["col_id"], e["z"]) - F.col("xty")) * 2 / F.col("n")
    mine = F.filter("entries", lambda t: t["col_id"] == F.col("i"))
    moved = table.join(state.select(*JOB, "lam", "entries"), P).select(
        *JOB, "lam", "i", "step", gradient.alias("grad"), mine.alias("mine"), F.explode("owners").alias("o"))
    own = F.get(F.filter("mine", lambda t: t["group_id"] == F.col("o.group_id")), F.lit(0))
    points = moved.select(
        *JOB, "lam", "step", F.col("o.group_id").alias("group_id"), F.col("o.weight").alias("weight"), "i",
        F.coalesce(own["w"], F.lit(0.0)).alias("old"), (F.coalesce(own["z"], F.lit(0.0)) - F.col("step") * F.col("grad")).alias("u"))
    grouped = points.groupBy(*JOB, "lam", "step", "group_id", "weight").agg(
        F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"), F.collect_list(F.struct("i", "old", "u")).alias("m"))
    keep = F.when(F.col("norm") > 0, F.greatest(F.lit(0.0), 1 - F.col("step") * F.col("lam") * F.col("weight") / F.nullif(F.col("norm"), F.lit(0.0)))).otherwise(0.0)
    new = F.transform("m", lambda t: F.struct(
        F.col("group_id").alias("group_id"), t["i"].cast("int").alias("col_id"), (t["u"] * F.col("keep")).alias("w"),
        (t["u"] * F.col("keep") * (1 + momentum) - t["old"] * momentum).alias("z")))
    shrunk = grouped.withColumn("keep", keep).select(
        *JOB, new.alias("new"),
        F.aggregate("m", F.lit(0.0), lambda a, t: F.greatest(a, F.abs(t["u"] * F.col("keep") - t["old"]))).alias("change"))
    packed = shrunk.groupBy(*JOB).agg(
        F.filter(F.flatten(F.collect_list("new")), lambda t: (t["w"] != 0) | (t["z"] != 0)).alias("entries"), F.max("change").alias("change"))
    return jobs.join(packed, JOB, "left").select(*JOB, "lam", F.coalesce("entries", none).alias("entries"), F.coalesce("change", F.lit(0.0)).alias("change"))


def group_weights(fitted: DataFrame) -> DataFrame:
    """Latent weights ``(job keys, lam, group_id, col_id, w)`` of a group lasso fit."""
    return fitted.select(*JOB, "lam", F.inline("entries")).filter("w <> 0").drop("z")


def logistic_group_lasso(rows: DataFrame, jobs: DataFrame, groups: DataFrame, balanced: bool = False, max_iter: int = 50, tol: float = 1e-6) -> DataFrame:
    """L13. Group lasso with logistic or class-balanced logistic loss and a free intercept."""
    if "weight" not in groups.columns:
        groups = groups.withColumn("weight", F.lit(1.0))
    groups = groups.withColumn("col_id", F.col("col_id").cast("int"))
    bound = _row_bound(rows.withColumn("x", F.concat("x", F.array(F.lit(1.0)))))
    steps = cut(_step_size(bound, groups, 0.25))
    shares = cut(class_shares(rows))
    jobs = cut(jobs.select(*JOB, "lam").join(steps, P).join(shares, P))
    weights = None
    model = cut(jobs.withColumns({"c": F.lit(0.0), "idx": F.expr(NO_IDX), "w": F.expr(NO_W)}))
    for _ in range(max_iter):
        joined = rows.join(model, P)
        margin = sparse_dot(F.col("x"), F.col("idx"), F.col("w")) + F.col("c")
        _, slope, _ = loss_terms("balanced" if balanced else "logistic", F.col("y"), margin, F.col("cp"), F.col("cn"))
        scored = joined.select(*JOB, F.concat("x", F.array(F.lit(1.0))).alias("x"), slope.alias("slope"))
        sums = cut(vector_sums(scored, JOB, "x", F.col("slope")))
        columns = sums.select(*JOB, F.posexplode("sums").alias("col_id", "_s"))
        moves = columns.join(groups, "col_id").join(jobs, JOB).select(*JOB, "lam", "step", "group_id", "col_id", "weight", (-F.col("step") * F.col("_s") / F.col("n")).alias("u"), F.lit(0.0).alias("old"))
        if weights is not None:
            held = weights.join(groups, ["group_id", "col_id"]).join(jobs, JOB).select(*JOB, "lam", "step", "group_id", "col_id", "weight", F.col("w").alias("u"), F.col("w").alias("old"))
            moves = moves.unionByName(held)
        points = moves.groupBy(*JOB, "lam", "step", "group_id", "weight", "col_id").agg(F.sum("u").alias("u"), F.sum("old").alias("old"))
        points = cut(points)
        norms = points.groupBy(*JOB, "group_id").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
        keep = F.when(F.col("norm") > 0, F.greatest(F.lit(0.0), 1 - F.col("step") * F.col("lam") * F.col("weight") / F.nullif(F.col("norm"), F.lit(0.0)))).otherwise(0.0)
        weights, moving = cut_count(
            points.join(norms, [*JOB, "group_id"]).select(*JOB, "group_id", "col_id", (F.col("u") * keep).alias("w"), F.abs(F.col("u") * keep - F.col("old")).alias("d")), f"d > {tol}")
        weights = weights.drop("d").filter("w <> 0")
        packed = _arrays(weights.groupBy(*JOB, "col_id").agg(F.sum("w").alias("b")), JOB, "b")
        slide = sums.select(*JOB, F.element_at("sums", -1).alias("_s"))
        model = cut(
            model.drop("idx", "w").join(slide, JOB).withColumn("c", F.col("c") - F.col("step") * F.col("_s") / F.col("n")).drop("_s")
            .join(packed, JOB, "left").withColumns({"idx": F.coalesce("idx", F.expr(NO_IDX)), "w": F.coalesce("w", F.expr(NO_W))}))
        if not moving:
            break
    latent = weights.groupBy(*JOB).agg(F.collect_list(F.struct("group_id", "col_id", "w")).alias("entries"))
    return model.select(*JOB, "lam", "c").join(latent, JOB, "left")


def squared_gradient(design: GramDesign, fitted: DataFrame) -> DataFrame:
    """Full loss gradient ``(job keys, lam, col_id, gradient)`` at the weights of a squared fit."""
    e = F.col("entries")
    joined = design.table.filter(F.col("block") == FULL).join(fitted, P).join(design.stats.select(P, "n"), P)
    value = (sparse_dot(F.col("g"), e["col_id"], e["w"]) - F.col("xty")) * 2 / F.col("n")
    return joined.select(*JOB, "lam", F.col("i").alias("col_id"), value.alias("gradient"))


def screen_groups(norms: DataFrame, active: DataFrame, most: int = 100) -> DataFrame:
    """L14. Groups to add: gradient norm above ``min(lam, largest norm among the active)``.

    ``norms(job keys, lam, group_id, norm)``, ``active(job keys, group_id)``.
    The ``most`` largest are added in a round; the rest wait for the next one.
    """
    flagged = norms.join(active.select(*JOB, "group_id").distinct().withColumn("_a", F.lit(True)), [*JOB, "group_id"], "left")
    level = flagged.groupBy(*JOB).agg(F.max(F.when(F.col("_a"), F.col("norm"))).alias("_top"))
    outside = flagged.filter("_a is null").join(level, JOB).filter(F.col("norm") > F.least("lam", F.coalesce("_top", "lam")))
    return top_k(outside, JOB, [F.col("norm").desc(), F.col("group_id")], most).select(*JOB, "group_id")


def possibly_active(norms: DataFrame, active: DataFrame) -> DataFrame:
    """L14. Groups that may be active in another minimum: norm within the error seen on the active ones."""
    on = norms.join(active.select(*JOB, "group_id").distinct(), [*JOB, "group_id"], "left_semi")
    slack = on.groupBy(*JOB).agg(F.max(F.abs(F.col("lam") - F.col("norm"))).alias("_e"))
    return norms.join(slack, JOB).filter(F.col("norm") >= F.col("lam") - F.col("_e")).select(*JOB, "group_id")


def active_set_lasso(design: GramDesign, jobs: DataFrame, groups: DataFrame, max_rounds: int = 20, max_iter: int = 200, tol: float = 1e-7) -> DataFrame:
    """L14. Group lasso that only touches columns of screened groups.

    Starts from the group of largest gradient and adds violating groups until
    none is left.  All jobs share the union of their active groups.
    """
    kind = groups.schema["group_id"].dataType.simpleString()
    fitted = cut(jobs.select(*JOB, "lam").withColumn("entries", F.expr(f"cast(array() as array<struct<group_id:{kind},col_id:int,w:double,z:double>>)")))
    chosen = None
    for _ in range(max_rounds):
        norms = cut(squared_gradient(design, fitted).join(groups, "col_id").groupBy(*JOB, "lam", "group_id").agg(F.sqrt(F.sum(F.col("gradient") * F.col("gradient"))).alias("norm")))
        if chosen is None:
            fresh, more = cut_count(top_k(norms, JOB, [F.col("norm").desc(), F.col("group_id")], 1).select("group_id").distinct(), "true")
            chosen = fresh
        else:
            shared = norms.select(*JOB, "group_id").join(chosen, "group_id", "left_semi")
            fresh, more = cut_count(screen_groups(norms, shared).select("group_id").distinct(), "true")
            chosen = cut(chosen.unionByName(fresh).distinct())
        if not more:
            break
        fitted = group_lasso(design, jobs, groups.join(chosen, "group_id", "left_semi"), max_iter, tol)
    return fitted


def refit(design: GramDesign, chosen: DataFrame, groups: DataFrame) -> DataFrame:
    """L16. Unpenalised fit on the columns of ``chosen(job keys, group_id)``.

    For the squared loss this is least squares on the chosen columns, solved
    from their normal equations.
    """
    columns = chosen.join(groups, "group_id").select(*JOB, F.col("col_id").cast("int").alias("col_id")).distinct()
    supports = columns.groupBy(*JOB).agg(F.collect_set("col_id").alias("idx"))
    return solve_normal(design.normal_on(supports), JOB).withColumnRenamed("idx", "col_id")


def lasso_path(rows: DataFrame, lambdas: DataFrame, max_iter: int = 200) -> DataFrame:
    """L15. Lasso over a grid of lambdas with centred columns: ``(job keys, lam, col_id, w)``.

    ``lambdas(problem_id, job_id, lam)``.  The data is read once for the path.
    """
    design = GramDesign.of(rows, centre=True)
    p = F.sequence(F.lit(0), F.col("p") - 1)
    singles = design.stats.select(F.explode(p).alias("col_id")).distinct().withColumn("group_id", F.col("col_id"))
    fitted = group_lasso(design, lambdas, singles.select("group_id", "col_id"), max_iter)
    return group_weights(fitted).select(*JOB, "lam", "col_id", "w")
