"""Group lasso for any number of columns, and the exact path of the lasso.

A fit touches the columns of its active groups only: their Gram matrix is summed in one pass over the rows and the small
problem is solved in a task by block coordinate steps.  A second pass takes the gradient of all columns at the solution;
groups whose gradient is beyond the penalty become active, and the fit ends when there are none.  The rows are read
twice a round, whatever the number of steps, and no matrix of all columns is ever held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparsetab.functions.scalar import sparse_dot
from sparsetab.lineage import cut, cut_count
from sparsetab.operators.iterate import P, _pack
from sparsetab.operators.matrix import gram, vector_sums
from sparsetab.operators.ranking import top_k
from sparsetab.operators.relational import attach_row
from sparsetab.operators.trees import by_problem

JOB = [P, "job_id"]


def block_steps(g: np.ndarray, xty: np.ndarray, n: float, blocks: list[np.ndarray], penalty: np.ndarray, start: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Weights of ``|y - X w|^2 / n + sum(penalty |w_block|)``, a block at a time; ``g`` is the Gram matrix of all blocks' columns.

    A block moves against its gradient by its own curvature, the largest eigenvalue of its part of the Gram matrix, and
    is shrunk as a whole.  Ends when no weight of a sweep moves by more than ``tol`` of the largest.
    """
    w, bend = start.copy(), [2.0 * np.linalg.eigvalsh(g[np.ix_(b, b)])[-1] / n if len(b) else 0.0 for b in blocks]
    down = 2.0 * (xty - g @ w) / n
    live = [k for k, curve in enumerate(bend) if curve > 0]
    for _ in range(steps):
        moved = 0.0
        for k in live:
            b = blocks[k]
            for _ in range(1 if len(b) == 1 else 5):
                u = w[b] + down[b] / bend[k]
                size = np.linalg.norm(u)
                new = u * max(0.0, 1.0 - penalty[k] / (bend[k] * size)) if size > 0 else u
                change = new - w[b]
                far = np.abs(change).max()
                if far == 0.0:
                    break
                w[b] = new
                down -= 2.0 * (g[:, b] @ change) / n
                moved = max(moved, far)
        if moved <= tol * np.abs(w).max(initial=1e-300):
            break
    return w


def wide_group_lasso(rows: DataFrame, jobs: DataFrame, groups: DataFrame, most: int = 100, tol: float = 1e-9, max_rounds: int = 200, steps: int = 20_000) -> DataFrame:
    """L13, L14. Group lasso with squared loss and a free intercept, for any number of columns.

    Minimises ``|y - c - X w|^2 / n + lam * sum(weight * |w_group|)`` over rows ``(problem_id, x, y)``, a column in several
    groups having one latent weight in each.  ``jobs(problem_id, job_id, lam)``, ``groups(group_id, col_id[, weight])``.
    Up to ``most`` groups beyond their penalty join the active ones of a job in a round, largest gradient first.  Returns
    for each job ``lam, entries(group_id, col_id, w), c, excess`` (by how much a gradient norm is beyond its penalty
    anywhere, as a share of the penalty) and ``converged``: no group beyond it by more than a part in a million.

    The columns of a job's active groups have to fit a task as a square matrix; all columns never do.
    """
    if "weight" not in groups.columns:
        groups = groups.withColumn("weight", F.lit(1.0))
    groups = cut(groups.select("group_id", F.col("col_id").cast("int").alias("col_id"), "weight"))
    kind = groups.schema["group_id"].dataType.simpleString()
    rows = rows.select(P, F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    sums = vector_sums(rows.select(P, F.concat("x", F.array("y", F.lit(1.0))).alias("x")), [P], "x")
    means = cut(sums.select(P, F.element_at("sums", -1).alias("n"), F.transform("sums", lambda v: v / F.element_at("sums", -1)).alias("m")))
    at = cut(jobs.select(*JOB, F.col("lam").cast("double").alias("lam")).join(means.select(P, "n", F.get("m", F.size("m") - 2).alias("c")), P))
    entries = f"array<struct<group_id:{kind},col_id:int,w:double>>"
    none = at.withColumn("entries", F.expr(f"cast(array() as {entries})"))
    fitted = none
    active = None
    for number in range(max_rounds):
        slopes = _gradients(rows, means, fitted)
        norms = cut(slopes.join(groups, "col_id").groupBy(*JOB, "lam", "group_id", "weight").agg(
            F.sqrt(F.sum(F.col("gradient") * F.col("gradient"))).alias("norm")).withColumn("excess", F.col("norm") / (F.col("lam") * F.col("weight")) - 1.0))
        outside = norms.filter("excess > 1e-6 or excess is null")
        if active is not None:
            outside = outside.join(active, [*JOB, "group_id"], "left_anti")
        fresh, more = cut_count(top_k(outside, JOB, [F.col("norm").desc(), F.col("group_id")], most).select(*JOB, "group_id"), "true")
        if not more or number == max_rounds - 1:
            break
        active = fresh if active is None else cut(active.unionByName(fresh))
        solved = _solved(rows, means, at.drop("c"), active.join(groups, "group_id"), fitted, steps, tol)
        fitted = cut(solved.unionByName(none.join(active.select(*JOB).distinct(), JOB, "left_anti").select(*solved.columns)))
    # where a group has weights its gradient equals the penalty; without any it is at most that
    worst = norms.groupBy(*JOB).agg(F.greatest(F.max("excess"), F.lit(0.0)).alias("excess"))
    return fitted.join(worst, JOB, "left").select(*JOB, "lam", "entries", "c", F.coalesce("excess", F.lit(0.0)).alias("excess"),
                                                  (F.coalesce("excess", F.lit(0.0)) <= 1e-6).alias("converged"))


def _gradients(rows: DataFrame, means: DataFrame, fitted: DataFrame) -> DataFrame:
    """Gradient of the loss in every column at the weights of every job: ``(job keys, lam, col_id, gradient)``."""
    model = fitted.select(*JOB, "lam", "n", F.col("entries.col_id").alias("idx"), F.col("entries.w").alias("w"))
    centred = rows.join(means.select(P, "m"), P).join(model, P)
    p = F.size("x")
    offset = sparse_dot(F.col("m"), F.col("idx"), F.col("w"))
    gap = sparse_dot(F.col("x"), F.col("idx"), F.col("w")) - offset - (F.col("y") - F.get("m", p))
    total = vector_sums(centred, [*JOB, "lam", "n"], "x", gap)  # the gaps sum to 0, so the means of the columns drop out
    return total.select(*JOB, "lam", F.posexplode(F.transform("sums", lambda v: 2.0 * v / F.col("n"))).alias("col_id", "gradient"))


def _solved(rows: DataFrame, means: DataFrame, jobs: DataFrame, members: DataFrame, fitted: DataFrame, steps: int, tol: float) -> DataFrame:
    """The fit of every job on the columns of its ``members(job keys, group_id, col_id, weight)``."""
    columns = members.groupBy(P).agg(F.array_sort(F.collect_set("col_id")).alias("cols"))
    limited = rows.join(columns, P).join(means.select(P, "m"), P).select(P, F.concat(
        F.transform("cols", lambda c: F.get(F.col("x"), c) - F.get(F.col("m"), c)), F.array(F.col("y") - F.get("m", F.size("x")))).alias("x"))
    last = F.size("sums") - 1
    whole = gram(limited, [P]).filter(F.col("i") < last).select(P, F.lit(0).alias("block"), "i", F.slice("sums", 1, last).alias("g"), F.get("sums", last).alias("xty"))
    packed = by_problem(whole, P, _pack, "p int, g binary, xty binary")
    lists = members.groupBy(*JOB).agg(F.array_sort(F.collect_list(F.struct("group_id", "col_id", "weight"))).alias("members"))
    work = jobs.join(lists, JOB).join(fitted.select(*JOB, "entries"), JOB).join(packed, P).join(columns, P).join(means.select(P, "m"), P)
    kind = work.schema[P].dataType.simpleString()
    names = [*JOB, "lam", "n", "entries", "c"]
    job_kind, group = work.schema["job_id"].dataType.simpleString(), work.schema["entries"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                r = one.to_pylist()[0]
                place = {c: i for i, c in enumerate(r["cols"])}
                at = np.array([place[m["col_id"]] for m in r["members"]])
                g = np.frombuffer(r["g"]).reshape(r["p"], r["p"])[np.ix_(at, at)]
                xty = np.frombuffer(r["xty"])[at]
                owner = [m["group_id"] for m in r["members"]]
                heads = [i for i in range(len(owner)) if i == 0 or owner[i] != owner[i - 1]]
                blocks = [np.arange(a, b) for a, b in zip(heads, [*heads[1:], len(owner)])]
                known = {(e["group_id"], e["col_id"]): e["w"] for e in r["entries"]}
                start = np.array([known.get((m["group_id"], m["col_id"]), 0.0) for m in r["members"]])
                w = block_steps(g, xty, r["n"], blocks, np.array([r["lam"] * r["members"][b[0]]["weight"] for b in blocks]), start, steps, tol)
                found = [{"group_id": m["group_id"], "col_id": m["col_id"], "w": float(v)} for m, v in zip(r["members"], w) if v != 0]
                c = r["m"][-2] - sum(e["w"] * r["m"][e["col_id"]] for e in found)
                yield pa.RecordBatch.from_arrays(
                    [one.column(P), one.column("job_id"), one.column("lam"), one.column("n"), pa.array([found], one.schema.field("entries").type), pa.array([c], pa.float64())], names)

    return work.mapInArrow(run, f"{P} {kind}, job_id {job_kind}, lam double, n double, entries {group.simpleString()}, c double")


def gram_group_lasso(design, jobs: DataFrame, groups: DataFrame, steps: int, tol: float) -> DataFrame:
    """The group lasso of ``fit.group_lasso`` for Gram matrices that fit a task: ``entries, change, converged`` of every job.

    ``groups(group_id, col_id, weight)``; every group is active from the start.
    """
    packed = by_problem(design.table.filter("block = -1").select(P, "block", "i", "g", "xty"), P, _pack, "p int, g binary, xty binary")
    lists = groups.agg(F.array_sort(F.collect_list(F.struct("group_id", F.col("col_id").cast("int").alias("col_id"), "weight"))).alias("members"))
    work = attach_row(jobs.select(*JOB, F.col("lam").cast("double").alias("lam")).join(packed, P).join(design.stats.select(P, "n"), P), lists)
    kind, job_kind = (work.schema[c].dataType.simpleString() for c in JOB)
    group = groups.schema["group_id"].dataType.simpleString()
    shape = f"array<struct<group_id:{group},col_id:int,w:double,z:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                r = one.to_pylist()[0]
                members = [m for m in r["members"] if 0 <= m["col_id"] < r["p"]]
                at = np.array([m["col_id"] for m in members], dtype=np.int64)
                g = np.frombuffer(r["g"]).reshape(r["p"], r["p"])[np.ix_(at, at)]
                heads = [i for i in range(len(members)) if i == 0 or members[i]["group_id"] != members[i - 1]["group_id"]]
                blocks = [np.arange(a, b) for a, b in zip(heads, [*heads[1:], len(members)])]
                penalty = np.array([r["lam"] * members[b[0]]["weight"] for b in blocks])
                w = block_steps(g, np.frombuffer(r["xty"])[at], r["n"], blocks, penalty, np.zeros(len(at)), steps, tol)
                again = block_steps(g, np.frombuffer(r["xty"])[at], r["n"], blocks, penalty, w, 1, 0.0)
                change = float(np.abs(again - w).max(initial=0.0))
                found = [{"group_id": m["group_id"], "col_id": m["col_id"], "w": float(v), "z": float(v)} for m, v in zip(members, w) if v != 0]
                yield pa.RecordBatch.from_arrays(
                    [one.column(P), one.column("job_id"), one.column("lam"), pa.array([found], entry), pa.array([change]), pa.array([change <= 10 * tol * max(1.0, np.abs(w).max(initial=0.0))])],
                    [*JOB, "lam", "entries", "change", "converged"])

    entry = to_arrow_type(T.DataType.fromDDL(shape))
    return work.mapInArrow(run, f"{P} {kind}, job_id {job_kind}, lam double, entries {shape}, change double, converged boolean")


# -- exact path ----------------------------------------------------------------------

def breakpoints(g: np.ndarray, xty: np.ndarray, n: float, least: float) -> list[tuple[float, np.ndarray]]:
    """Values of lambda at which a weight of the lasso starts or ends, from the largest down to ``least``, with the weights there.

    Minimises ``|y - X w|^2 / n + lam |w|_1``.  Between two breakpoints the weights are linear in lambda: those of the
    active columns follow the solution of their normal equations with the signs as right side.
    """
    w, out = np.zeros(len(xty)), []
    slope = 2.0 * xty / n
    lam = float(np.abs(slope).max(initial=0.0))
    if lam <= least:
        return [(lam, w)]
    out.append((lam, w.copy()))
    active = [int(np.abs(slope).argmax())]
    for _ in range(50 * len(xty)):
        sign = np.sign(slope[active])
        sign = np.where(w[active] != 0, np.sign(w[active]), sign)
        lead = np.zeros(len(xty))
        lead[active] = np.linalg.solve(2.0 * g[np.ix_(active, active)] / n, sign)  # growth of the weights as lambda falls by 1
        fall = 2.0 * (g @ lead) / n  # by which slopes shrink then
        best, event = lam - least, None
        for j in range(len(xty)):
            if j in active:
                if lead[j] * w[j] < 0 and -w[j] / lead[j] < best:
                    best, event = -w[j] / lead[j], (j, False)
                continue
            for up in (1.0, -1.0):
                rate = up - fall[j]
                step = (up * lam - slope[j]) / rate if abs(rate) > 1e-14 else -1.0
                if 1e-12 * lam < step < best:
                    best, event = step, (j, True)
        w, slope, lam = w + best * lead, slope - best * fall, lam - best
        if event is not None and not event[1]:
            w[event[0]] = 0.0
        out.append((float(lam), w.copy()))
        if event is None or lam <= least:
            return out
        active = sorted([*active, event[0]]) if event[1] else [j for j in active if j != event[0]]
        if not active:
            return out
    return out


def lasso_breakpoints(design, least: float) -> DataFrame:
    """L15. The whole path of the lasso on centred columns: ``(problem_id, step, lam, idx, w)`` at every breakpoint.

    ``design``: a ``fit.GramDesign`` of centred columns whose Gram matrices fit a task.  Weights between two breakpoints
    lie on the line between them, so the path is exact for every lambda down to ``least``.  Active columns have to be
    independent of each other.
    """
    packed = by_problem(design.table.filter("block = -1").select(P, "block", "i", "g", "xty"), P, _pack, "p int, g binary, xty binary")
    work = packed.join(design.stats.select(P, "n"), P)
    kind = work.schema[P].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                r = one.to_pylist()[0]
                path = breakpoints(np.frombuffer(r["g"]).reshape(r["p"], r["p"]), np.frombuffer(r["xty"]), r["n"], least)
                at = [np.flatnonzero(w) for _, w in path]
                yield pa.RecordBatch.from_arrays(
                    [one.column(P).take(pa.array([0] * len(path))), pa.array(range(len(path)), pa.int32()), pa.array([lam for lam, _ in path], pa.float64()),
                     pa.array([a.tolist() for a in at], pa.list_(pa.int32())), pa.array([w[a].tolist() for a, (_, w) in zip(at, path)], pa.list_(pa.float64()))],
                    [P, "step", "lam", "idx", "w"])

    return work.mapInArrow(run, f"{P} {kind}, step int, lam double, idx array<int>, w array<double>")
