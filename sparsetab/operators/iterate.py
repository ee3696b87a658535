"""Fits that iterate inside a task, on normal equations that were summed by Spark.

The rows are read once, by all tasks; what is left of a problem is its Gram matrices, ``X'y`` and ``y'y``.  Where these
fit a task (``LIMIT`` numbers), every job of every problem is one row of work that holds them, and all its steps are
taken there.  Drawn blocks that do not fit together pass through such a task one after another, in the order they are
drawn.  Wider designs take their steps as Spark jobs (``fit``).  All give the same weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsetab.lineage import cut, cut_count
from sparsetab.operators import search, trees
from sparsetab.operators.matrix import chosen_block
from sparsetab.operators.trees import Prizes, by_problem, column, least_forest

P = "problem_id"
JOB = [P, "job_id"]
FULL = -1
LIMIT = 1 << 22  # numbers in all Gram matrices of a problem that a task takes
ROWS = 1 << 4  # times LIMIT: numbers in the rows of a problem that a task holds, once

# Constants of the normalised step rule.
NIHT_C = 0.01
NIHT_KAPPA = 2.0 / (1.0 - NIHT_C)
NIHT_TRIES = 40


def fits(p: int, blocks: int) -> bool:
    return p * p * (blocks + 1) <= LIMIT


def _pack(table: pa.Table) -> dict[str, list]:
    """Gram matrices of a problem by block and row, as one row."""
    block, i = column(table, "block"), column(table, "i")
    order = np.lexsort((i, block))
    flat = table.column("g").combine_chunks()
    width = len(flat[0])
    g = flat.flatten().to_numpy().reshape(-1, width)[order]
    return {"p": pa.array([width], pa.int32()), "g": pa.array([g.tobytes()], pa.binary()), "xty": pa.array([column(table, "xty")[order].tobytes()], pa.binary())}


def _pack_edges(table: pa.Table) -> dict[str, list]:
    parts = [column(table, c).astype(np.float64 if c == "cost" else np.int64).tobytes() for c in ("src", "dst", "cost")]
    return {c: pa.array([v], pa.binary()) for c, v in zip(("src", "dst", "cost"), parts)}


class Normal:
    """Normal equations of one problem: ``g[0]`` and ``xty[0]`` of all rows, then those of each block."""

    def __init__(self, p: int, g: bytes, xty: bytes, yy: float):
        self.g = np.frombuffer(g).reshape(-1, p, p)
        self.xty, self.yy, self.p = np.frombuffer(xty).reshape(-1, p), yy, p

    def gradient(self, w: np.ndarray, block: int = FULL) -> np.ndarray:
        return self.g[block + 1] @ w - self.xty[block + 1]

    def rss(self, w: np.ndarray) -> float:
        return abs(self.yy + w @ (self.g[0] @ w - 2 * self.xty[0]))

    def solve(self, support: np.ndarray) -> np.ndarray:
        out = np.zeros(self.p)
        if len(support):
            out[support] = np.linalg.pinv(self.g[0][np.ix_(support, support)], rcond=1e-12, hermitian=True) @ self.xty[0][support]
        return out


def largest(v: np.ndarray, s: int) -> np.ndarray:
    """The ``s`` entries of largest magnitude, the first of equals; zeros are none."""
    at = np.lexsort((np.arange(len(v)), -np.abs(v)))[:s]
    out = np.zeros(len(v))
    out[at] = v[at]
    return out


class Lattice:
    """Connected supports of a band of sizes, with ``v * v`` as prizes."""

    def __init__(self, p: int, src: np.ndarray, dst: np.ndarray, cost: np.ndarray, g: int, root: int | None):
        inside = (src != dst) & (np.minimum(src, dst) >= 0) & (np.maximum(src, dst) < p)
        self.a, self.b, self.cost = np.minimum(src, dst)[inside], np.maximum(src, dst)[inside], cost[inside]
        self.p, self.root = p, root if root is not None and 0 <= root < p else None
        self.g = g if self.root is None else 1

    def limited(self, v: np.ndarray, low: int, high: int, rounds: int) -> tuple[np.ndarray, bool]:
        prize = v * v
        tree = least_forest(self.a, self.b, [self.cost, -np.minimum(prize[self.a], prize[self.b]), self.a, self.b])
        cost = self.cost[tree]
        prizes = Prizes(prize.tolist(), self.a[tree].tolist(), self.b[tree].tolist(), cost.tolist(), self.root)
        limits, points = search.limits_of(prize, cost, self.g == 1), {}
        for number in range(rounds + 1):
            lams, picks, met, _ = search.size_band(points, limits, low, max(low, high), 8, number == rounds)
            if picks:
                break
            points |= {lam: prizes.score(lam, self.g) for lam in lams}
        out = np.zeros(self.p)
        for tree_ in prizes.best(picks[0][1], self.g):
            out[tree_[3]] = v[tree_[3]]
        return out, met


def drawn(seed: int, problem, job, epoch: int, number: int, blocks: int) -> int:
    """The block of ``matrix.chosen_block``."""
    text = "|".join(str(k) for k in (seed, problem, job, epoch, number))
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) % blocks


class Run:
    """Weights of a job, epoch by epoch, until a stop rule holds."""

    def __init__(self, normal: Normal, max_epochs: int, tol: float):
        self.normal, self.max_epochs, self.tol = normal, max_epochs, tol
        self.w, self.epochs, self.rss, self.done, self.converged, self.in_band = np.zeros(normal.p), 0, None, False, False, True

    def through(self, step: Callable[[np.ndarray, int], np.ndarray]) -> "Run":
        for epoch in range(self.max_epochs):
            old, self.w = self.w, step(self.w, epoch)
            if self.ended(old):
                break
        return self

    def ended(self, old: np.ndarray) -> bool:
        """Whether a stop rule holds after an epoch that began with the weights ``old``."""
        self.epochs += 1
        self.rss = self.normal.rss(self.w)
        if np.linalg.norm(self.w) >= 1e3:
            self.done = True
        else:
            still = np.abs(self.w - old).max(initial=0.0) <= self.tol * np.abs(self.w).max(initial=0.0)
            self.done = self.converged = bool(np.sqrt(self.rss) <= self.tol or still)
        return self.done


def _thresholded(run: Run, w: np.ndarray, gradient: np.ndarray, rate: float, s: int, graph: Lattice | None = None,
                 gamma: float = 0.0, rounds: int = 0) -> np.ndarray:
    """Weights after a step along ``gradient``."""
    if graph is None:
        return largest(w - rate * gradient, s)
    head = len(w) // 2
    gradient, one = graph.limited(gradient, head, int(head * (1 + gamma)), rounds)
    kept, two = graph.limited(w - rate * gradient, s, int(s * (1 + gamma)), rounds)
    run.in_band = run.in_band and one and two
    return kept


def hard_thresholding(normal: Normal, run: Run, job: dict, s: int, stochastic: bool, seed: int, **graph) -> Run:
    blocks = len(normal.g) - 1

    def step(w: np.ndarray, epoch: int) -> np.ndarray:
        if not stochastic:
            return _thresholded(run, w, normal.gradient(w), job["lr"], s, **graph)
        for number in range(blocks):
            block = drawn(seed, job[P], job["job_id"], epoch, number, blocks)
            w = _thresholded(run, w, normal.gradient(w, block), 2.0 * job["lr"], s, **graph)
        return w

    return run.through(step)


def normalised(normal: Normal, run: Run, job: dict, s: int) -> Run:
    gamma = np.flatnonzero(largest(normal.gradient(run.w), s))

    def step(w: np.ndarray, epoch: int) -> np.ndarray:
        nonlocal gamma
        down = -normal.gradient(w)
        on = np.zeros(normal.p)
        on[gamma] = down[gamma]
        energy = on @ normal.g[0] @ on
        mu = on @ on / energy if energy > 0 else 1.0
        for k in range(NIHT_TRIES):
            new = largest(w + mu * down, s)
            support = np.flatnonzero(new)
            if k == 0 and np.array_equal(support, gamma):
                return new
            move = new - w
            bend = move @ normal.g[0] @ move
            if k == 0 and bend <= 0:
                return w
            if bend <= 0 or mu * bend <= (1 - NIHT_C) * (move @ move):
                gamma = support
                return new
            mu /= NIHT_KAPPA * (1 - NIHT_C)
        return w

    return run.through(step)


def pursuit(normal: Normal, run: Run, job: dict, s: int, graph: Lattice | None = None, gamma: float = 0.0, rounds: int = 0) -> Run:
    def step(w: np.ndarray, epoch: int) -> np.ndarray:
        gradient = normal.gradient(w)
        if graph is None:
            new = largest(gradient, 2 * s)
        else:
            new, one = graph.limited(gradient, 2 * s, int(2 * s * (1 + gamma)), rounds)
        solved = normal.solve(np.flatnonzero((w != 0) | (new != 0)))
        if graph is None:
            return largest(solved, s)
        kept, two = graph.limited(solved, s, int(s * (1 + gamma)), rounds)
        run.in_band = run.in_band and one and two
        return kept

    return run.through(step)


_STATE = "idx array<int>, w array<double>, block int, epochs int, rss double, done boolean, converged boolean, in_band boolean"
_STATE_KINDS = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_()]


def _shape(graph) -> tuple | None:
    return None if graph is None else (graph.g, graph.root, graph.gamma, graph.rounds)


def _lattice(shape: tuple | None, row: dict) -> dict:
    """The graph of a row, as the steps take it."""
    if shape is None:
        return {}
    ends = [np.frombuffer(row[c] or b"", dtype=np.int64) for c in ("src", "dst")]
    return {"graph": Lattice(row["p"], *ends, np.frombuffer(row["cost"] or b""), *shape[:2]), "gamma": shape[2], "rounds": shape[3]}


def _result(job: pa.Array, done: Run) -> pa.RecordBatch:
    at = np.flatnonzero(done.w)
    values = [at.astype(np.int32).tolist(), done.w[at].tolist(), FULL, done.epochs, done.rss, done.done, done.converged, done.in_band]
    names = ["job", *(f.split()[0] for f in _STATE.split(", "))]
    return pa.RecordBatch.from_arrays([job, *(pa.array([v], t) for v, t in zip(values, _STATE_KINDS))], names)


def run_jobs(design, jobs: DataFrame, method: Callable[..., Run], max_epochs: int, tol: float, graph=None, **more) -> DataFrame:
    """State of every job: its columns, ``idx, w, block, epochs, rss, done, converged``, with a graph also ``in_band``."""
    packed = by_problem(design.table.select(P, "block", "i", "g", "xty"), P, _pack, "p int, g binary, xty binary")
    names = jobs.columns
    work = jobs.select(P, F.struct(*names).alias("job")).join(packed, P).join(design.stats.select(P, "yy"), P)
    shape = _shape(graph)
    if graph is not None:
        edges = by_problem(graph.edges.select(P, "src", "dst", "cost"), P, _pack_edges, "src binary, dst binary, cost binary")
        work = work.join(edges, P, "left")
    job_type = jobs.schema.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                r = row.to_pylist()[0]
                normal = Normal(r["p"], r["g"], r["xty"], r["yy"])
                yield _result(row.column("job"), method(normal, Run(normal, max_epochs, tol), r["job"], **more, **_lattice(shape, r)))

    out = work.mapInArrow(run, f"job {job_type}, {_STATE}")
    return out.select("job.*", *_last(graph))


def _last(graph) -> list[str]:
    return ["idx", "w", "block", "epochs", "rss", "done", "converged"] + (["in_band"] if graph is not None else [])


STEPS = 256  # steps of a job that one round of drawn blocks covers, an epoch at least


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the epoch or the number of the drawn block changes."""
    for batch in batches:
        if batch.num_rows:
            epoch, number = (batch.column(c).to_numpy() for c in ("epoch", "number"))
            starts = np.flatnonzero((np.diff(epoch, prepend=epoch[0] - 1) != 0) | (np.diff(number, prepend=number[0]) != 0))
            for one, two in zip(starts, [*starts[1:], batch.num_rows]):
                yield batch.slice(one, two - one)


class _Streamed:
    """A job whose blocks arrive one after another: what has come of the block that is open, and the run."""

    def __init__(self, row: pa.RecordBatch, max_epochs: int, tol: float, s: int, shape: tuple | None):
        self.head = row.column("head")
        self.told = self.head[0].as_py()
        self.max_epochs, self.tol, self.s = max_epochs, tol, s
        self.graph, self.run, self.parts, self.at = _lattice(shape, self.told), None, [], (FULL, 0)

    def take(self, part: pa.RecordBatch) -> None:
        at = (part.column("epoch")[0].as_py(), part.column("number")[0].as_py())
        if at != self.at:
            self.close(at[0])
            self.at = at
        # a job that has ended reads on without a step
        if self.run is None or not self.run.done:
            g = part.column("g")
            self.parts.append((g.flatten().to_numpy().reshape(len(g), -1), part.column("xty").to_numpy()))

    def close(self, epoch: int | None) -> None:
        """Takes the step of the open block, and judges its epoch if the next block is of another one."""
        if not self.parts:
            return
        g, xty = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        if self.run is None:
            told = self.told
            self.run = Run(Normal(told["p"], g.tobytes(), xty.tobytes(), told["yy"]), self.max_epochs, self.tol)
            self.run.w[told["idx"]] = told["w"]
            self.run.epochs, self.run.in_band, self.run.rss = told["epochs"], told["in_band"], told["rss"]
            self.old = self.run.w
            return
        run = self.run
        run.w = _thresholded(run, run.w, g @ run.w - xty, 2.0 * self.told["job"]["lr"], self.s, **self.graph)
        if epoch != self.at[0]:
            run.ended(self.old)
            self.old = run.w

    def result(self) -> pa.RecordBatch:
        self.close(None)
        return _result(self.head.field("job"), self.run)


def run_drawn(design, jobs: DataFrame, s: int, max_epochs: int, tol: float, seed: int, graph=None) -> DataFrame:
    """Hard thresholding on drawn blocks whose Gram matrices do not fit a task together; the state is that of ``run_jobs``.

    Which blocks an epoch draws is known before it begins.  A round of Spark deals every job the blocks of its next
    epochs in the order of the steps, and the job's task holds the matrix of one block at a time.
    """
    shape = _shape(graph)
    table, stats = design.table, design.stats.select(P, "yy", "p", "num_blocks")
    if graph is not None:
        edges = by_problem(graph.edges.select(P, "src", "dst", "cost"), P, _pack_edges, "src binary, dst binary, cost binary")
        stats = stats.join(edges, P, "left")
    stats = cut(stats)
    more = ["src", "dst", "cost"] if graph is not None else []
    blocks = stats.agg(F.max("num_blocks")).first()[0] or 1
    each = max(1, STEPS // blocks)
    live = cut(jobs.select(*JOB, F.struct(*jobs.columns).alias("job"), F.expr("cast(array() as array<int>)").alias("idx"), F.expr("cast(array() as array<double>)").alias("w"),
                           F.lit(FULL).alias("block"), F.lit(0).alias("epochs"), F.lit(None).cast("double").alias("rss"),
                           F.lit(False).alias("done"), F.lit(False).alias("converged"), F.lit(True).alias("in_band")))
    names, done = live.columns, []
    at = lambda epoch, number: [F.lit(v).cast("int").alias(c) for v, c in ((epoch, "epoch"), (number, "number"))]
    none = F.lit(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = None
        for part in _in_runs(batches):
            if part.column("epoch")[0].as_py() == FULL - 1:
                for k in range(part.num_rows):
                    if job is not None:
                        yield job.result()
                    job = _Streamed(part.slice(k, 1), max_epochs, tol, s, shape)
            else:
                job.take(part)
        if job is not None:
            yield job.result()

    job_type = jobs.schema.simpleString()
    for first in range(0, max_epochs, each):
        last = min(first + each, max_epochs)
        known = live.join(stats, P)
        head = F.struct("job", "idx", "w", "epochs", "rss", "in_band", "yy", "p", *more)
        heads = known.select(*JOB, *at(FULL - 1, 0), F.lit(-1).alias("i"), none.cast("array<double>").alias("g"), none.cast("double").alias("xty"), head.alias("head"))
        steps = known.select(*JOB, "num_blocks", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("epoch")).withColumn(
            "number", F.explode(F.sequence(F.lit(0), F.col("num_blocks") - 1)))
        steps = steps.withColumn("block", chosen_block(seed, F.col("epoch"), F.col("number"), F.col("num_blocks"), *JOB).cast("int")).drop("num_blocks")
        whole = live.select(*JOB, *at(FULL, 0), F.lit(FULL).alias("block"))
        dealt = steps.unionByName(whole).join(table, [P, "block"]).select(*JOB, "epoch", "number", "i", "g", "xty", none.cast(heads.schema["head"].dataType).alias("head"))
        rows = heads.unionByName(dealt).repartition(*JOB).sortWithinPartitions(*JOB, "epoch", "number", "i")
        ran = rows.select("epoch", "number", "g", "xty", "head").mapInArrow(run, f"job {job_type}, {_STATE}")
        live, left = cut_count(ran.select(*[F.col(f"job.{c}").alias(c) for c in JOB], *names[2:]), "not done")
        done.append(live.filter("done"))
        live = live.filter("not done")
        if not left:
            break
    for part in done:
        live = live.unionByName(part)
    return live.select("job.*", *_last(graph))


# Shrink factor and number of tries of the step search.
BETA = 0.8
STEP_TRIES = 20


def balanced_steps(x: np.ndarray, y: np.ndarray, starts: np.ndarray, job: dict, s: int, max_epochs: int, tol: float, num_blocks: int, seed: int,
                   sum_intercept: bool, graph: Lattice | None = None, gamma: float = 0.0, rounds: int = 0):
    """Weights, intercept, epochs, whether they stand still and whether supports met their bands: see ``fit.balanced_iht``.

    Block ``k`` is the rows from ``starts[k]`` up to ``starts[k + 1]``.
    """
    share = np.where(y > 0, (y < 0).mean(), (y > 0).mean())
    w, c, lam, in_band = np.zeros(x.shape[1]), 0.0, job["lam"], True
    for epoch in range(max_epochs):
        old, before = w, c
        for number in range(num_blocks):
            block = drawn(seed, job[P], job["job_id"], epoch, number, num_blocks) if num_blocks > 1 else 0
            at = slice(starts[block], starts[block + 1])
            rows, sign, cost = x[at], y[at], share[at]
            n = len(rows)
            if not n:
                continue
            z = sign * (rows @ w + c)
            slope = -cost * sign * np.exp(-np.logaddexp(0, z))
            g, gc = rows.T @ slope / n + lam * w, slope.sum() / (1.0 if sum_intercept else n)
            if graph is not None:
                head = x.shape[1] // 2
                g, met = graph.limited(g, head, int(head * (1 + gamma)), rounds)
                in_band = in_band and met
            start = (cost * np.logaddexp(0, -z)).mean() + lam / 2 * w @ w
            slide = sign * (rows @ g + gc)
            for t in range(STEP_TRIES + 1):
                step = BETA ** t
                ahead = w - step * g
                if t == STEP_TRIES or (cost * np.logaddexp(0, -(z - step * slide))).mean() + lam / 2 * ahead @ ahead <= start - step / 2 * (g @ g + gc * gc):
                    break
            if graph is None:
                w = largest(ahead, s)
            else:
                w, met = graph.limited(ahead, s, int(s * (1 + gamma)), rounds)
                in_band = in_band and met
            c -= step * gc
        if np.abs(w - old).max(initial=0.0) <= tol * np.abs(w).max(initial=0.0) and abs(c - before) <= tol * max(1.0, abs(c)):
            return w, c, epoch + 1, True, in_band
    return w, c, max_epochs, False, in_band


class _Rows:
    """A job whose rows arrive one after another, held once."""

    def __init__(self, row: pa.RecordBatch):
        self.head = row.column("head")
        self.told = self.head[0].as_py()
        self.x, self.y = np.empty((self.told["n"], self.told["p"])), np.empty(self.told["n"])
        self.row, self.filled = np.empty(self.told["n"], dtype=np.int64), 0

    def take(self, part: pa.RecordBatch) -> None:
        at = slice(self.filled, self.filled + part.num_rows)
        self.x[at] = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
        self.y[at], self.row[at], self.filled = part.column("y").to_numpy(), part.column("row_id").to_numpy(), at.stop

    def result(self, s: int, max_epochs: int, tol: float, num_blocks: int, seed: int, sum_intercept: bool, shape: tuple | None) -> pa.RecordBatch:
        size = len(self.y) // num_blocks
        starts = np.searchsorted(self.row, np.arange(num_blocks + 1) * size)
        w, c, epochs, converged, met = balanced_steps(
            self.x, self.y, starts, self.told["job"], s, max_epochs, tol, num_blocks, seed, sum_intercept, **_lattice(shape, self.told))
        at = np.flatnonzero(w)
        values = [at.astype(np.int32).tolist(), w[at].tolist(), c, epochs, converged, met]
        kinds = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [self.head.field("job"), *(pa.array([v], t) for v, t in zip(values, kinds))], ["job", "idx", "w", "c", "epochs", "converged", "in_band"])


def run_balanced(rows: DataFrame, jobs: DataFrame, s: int, max_epochs: int, tol: float, num_blocks: int, seed: int, sum_intercept: bool, graph=None) -> DataFrame:
    """``fit.balanced_iht`` for problems whose rows fit a task, all steps of a job in one.

    The rows of a job reach its task in their order and are held there once, as numbers.
    """
    shape = _shape(graph)
    told = rows.groupBy(P).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p"))
    if graph is not None:
        told = told.join(by_problem(graph.edges.select(P, "src", "dst", "cost"), P, _pack_edges, "src binary, dst binary, cost binary"), P, "left")
    more = ["src", "dst", "cost"] if graph is not None else []
    known = cut(jobs.select(*JOB, F.struct(*jobs.columns).alias("job")).join(told, P))
    none = F.lit(None)
    heads = known.select(*JOB, none.cast("long").alias("row_id"), none.cast("array<double>").alias("x"), none.cast("double").alias("y"), F.struct("job", "n", "p", *more).alias("head"))
    dealt = rows.select(P, F.col("row_id").cast("long").alias("row_id"), "x", F.col("y").cast("double").alias("y")).join(known.select(*JOB), P).select(
        *JOB, "row_id", "x", "y", none.cast(heads.schema["head"].dataType).alias("head"))
    # ranges deal jobs more evenly than a hash of a few keys does
    every = max(1, known.count())
    ordered = heads.unionByName(dealt).repartitionByRange(every, *JOB).sortWithinPartitions(*JOB, F.col("head").isNull(), "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = None
        for batch in batches:
            tops = np.flatnonzero(batch.column("head").is_valid().to_numpy(zero_copy_only=False))
            if batch.num_rows and (not len(tops) or tops[0] > 0):
                job.take(batch.slice(0, tops[0] if len(tops) else batch.num_rows))
            for one, two in zip(tops, [*tops[1:], batch.num_rows]):
                if job is not None:
                    yield job.result(s, max_epochs, tol, num_blocks, seed, sum_intercept, shape)
                job = _Rows(batch.slice(one, 1))
                if two > one + 1:
                    job.take(batch.slice(one + 1, two - one - 1))
        if job is not None:
            yield job.result(s, max_epochs, tol, num_blocks, seed, sum_intercept, shape)

    out = ordered.select("row_id", "x", "y", "head").mapInArrow(
        run, f"job {jobs.schema.simpleString()}, idx array<int>, w array<double>, c double, epochs int, converged boolean, in_band boolean")
    return out.select("job.*", "idx", "w", "c", "epochs", "converged", *(["in_band"] if graph is not None else []))


def oversized_graph(edges: DataFrame) -> bool:
    """Whether some problem has more edges than a task takes."""
    return not edges.groupBy(P).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > trees.LIMIT).isEmpty()
