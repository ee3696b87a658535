"""Exact search for the largest inner products, with vectors in order of descending length.

Candidates are sorted by length and packed into blocks of about ``BLOCK`` rows.  A query first meets a bounded seed, the
longest vectors; its score there is a floor that its k-th best cannot fall below.  With that floor, and by
Cauchy-Schwarz, a query needs no block whose longest vector is too short, no row of a block beyond the first that is
too short, and of the rest only rows for which the inner product over the leading directions plus the product of the
remaining lengths reaches the floor.  Leading directions come from the singular vectors of the seed and a bounded
sample; any rotation gives right results, this one concentrates the length.  Survivors are scored exactly in
integers.

Queries are packed by the length they ask for, so a block of queries skips blocks as a whole, and are shuffled to groups
of candidate blocks, in as few bytes a component as hold it; a pair of blocks returns at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from sparsetab.lineage import cut

BLOCK = 4096
QUERIES = 512  # of a block of queries
SEED = 2048  # longest vectors that give each query its first floor
SAMPLE = 2048  # vectors that the rotation is fitted on
GROUP = 2  # candidate blocks of a group
LEADING = 16  # directions of a partial sum
_EXACT = float(1 << 53)
_PACKED = "longest double, least double, n int, item int, ids binary, x binary, floors binary"


def whole_numbers(x: str, scale: float) -> Column:
    """Components times ``scale``, rounded down; null for vectors that are null or hold null or non-finite components."""
    fine = F.col(x).isNotNull() & F.forall(F.col(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(F.col(x), lambda v: F.floor(v.cast("double") * scale)))


def _matrix(rows: list, width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        x[i, :len(r)] = r
    return x


def _lengths(x: np.ndarray) -> np.ndarray:
    """Lengths, rounded up a little."""
    return np.linalg.norm(x.astype(np.float64), axis=1) * (1 + 1e-12)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products as integers; floating sums only where they are exact."""
    if len(x) and len(y) and _lengths(x).max() * _lengths(y).max() < _EXACT / 2:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= floor)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them all."""
    low, high = x.min(initial=0), x.max(initial=0)
    return x.astype(next(f"i{b}" for b in (1, 2, 4, 8) if np.iinfo(f"i{b}").min <= low and high <= np.iinfo(f"i{b}").max))


def _packer(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            x = _matrix([r[1] for r in own], max(len(r[1]) for r in own))
            packed = _narrow(x)
            floors = np.array([r[2] for r in own], dtype=np.float64)
            lengths = _lengths(x)
            least = np.where(floors == -np.inf, 0.0, floors / np.maximum(lengths, 1e-300))
            return pa.RecordBatch.from_arrays(
                [pa.array([float(lengths.max())]), pa.array([float(min(least.min(), 1e300))]), pa.array([len(own)], pa.int32()),
                 pa.array([packed.itemsize], pa.int32()), pa.array([np.array([r[0] for r in own], dtype=np.int64).tobytes()], pa.binary()),
                 pa.array([packed.tobytes()], pa.binary()), pa.array([floors.tobytes()], pa.binary())],
                ["longest", "least", "n", "item", "ids", "x", "floors"])

        own: list = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("id", "x", "floor"))):
                own.append(r)
                if len(own) == size:
                    yield row()
                    own = []
        if own:
            yield row()

    return pack


def _unpacked(block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a packed block, filled up with zeros to ``width``."""
    x = np.frombuffer(block["x"], dtype=f"i{block['item']}").astype(np.int64)
    x = x.reshape(block["n"], x.size // block["n"])
    return np.frombuffer(block["ids"], dtype=np.int64), np.pad(x, ((0, 0), (0, width - x.shape[1])))


def block_pairs(q: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, x: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int):
    """For each query that has any: its number, and places and scores of its best rows of a block in order of length."""
    size, long = _lengths(q), _lengths(x)
    rows = int(np.searchsorted(-long, -np.min(np.where(floors == -np.inf, -1.0, floors / np.maximum(size, 1e-300))), side="right"))
    x, ids, long = x[:rows], ids[:rows], long[:rows]
    if not rows:
        return
    turned, other = q @ rotation, x @ rotation
    m = min(LEADING, rotation.shape[1])
    rest, remaining = (np.linalg.norm(v[:, m:], axis=1) for v in (turned, other))
    bound = turned[:, :m] @ other[:, :m].T + rest[:, None] * remaining[None, :] + 1e-9 * (1.0 + size[:, None] * long[None, :])
    possible = (bound >= floors[:, None]) & (query_ids[:, None] != ids[None, :])
    del bound
    exact = products(q, x) if possible.mean() > 0.1 else None
    for i in np.flatnonzero(possible.any(axis=1)):
        at = np.flatnonzero(possible[i])
        score = exact[i, at] if exact is not None else products(q[i:i + 1], x[at])[0]
        at, score = at[score >= floors[i]], score[score >= floors[i]]
        own = _best(score, ids[at], k)
        yield i, at[own], score[own]


def _bounded(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a limited table, which reach the driver as packed blocks."""
    packed = rows.select("id", "x", F.lit(float("-inf")).alias("floor")).mapInArrow(_packer(SEED), _PACKED).collect()
    ids, x = zip((np.zeros(0, dtype=np.int64), np.zeros((0, width), dtype=np.int64)), *(_unpacked(r, width) for r in packed))
    return np.concatenate(ids), np.concatenate(x)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``vectors(id, x)`` with whole-number arrays; the ``k`` largest inner products of every query row.

    Returns ``query_id, rank, id, score``, ties to the smaller id; all candidates where there are fewer than ``k``.
    Rows with a null id or null vector take no part.  Candidates are all rows but those with the query's own id; rows
    that repeat a query's id are one query with several vectors and give its best scores over them.  Shorter vectors
    count as filled up with zeros.  Scores are exact while they fit 64-bit integers.
    """
    rows = vectors.select("id", F.col("x").cast("array<long>").alias("x"), is_query.alias("_query")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = cut(rows.withColumn("_square", square).withColumn("_width", F.size("x")))
    width = rows.agg(F.max("_width")).first()[0] or 1
    seed_ids, seed = _bounded(rows.orderBy(F.col("_square").desc(), "id").limit(SEED), width)
    fitted = np.concatenate([seed, _bounded(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE), width)[1]]).astype(np.float64)
    rotation = np.linalg.svd(fitted / max(1.0, np.abs(fitted).max(initial=0.0)), full_matrices=True)[2].T if len(fitted) >= 1 else np.eye(width)

    def floors(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                ids, q = part.column("id").to_numpy(), _matrix(part.column("x").to_pylist(), width)
                score = products(q, seed).astype(np.float64)
                score[ids[:, None] == seed_ids[None, :]] = -np.inf
                floor = np.sort(score, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(ids), -np.inf)
                length = _lengths(q)
                need = np.where(floor == -np.inf, -1.0, floor / np.maximum(length, 1e-300))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("x"), pa.array(floor), pa.array(need)], ["id", "x", "floor", "need"])

    asked = rows.where("_query").select("id", "x").mapInArrow(floors, "id long, x array<long>, floor double, need double")
    # a query block is a row; the id spreads equal lengths over blocks
    by_need = asked.repartitionByRange(F.col("need").desc(), F.xxhash64("id")).sortWithinPartitions(F.col("need").desc(), "id")
    queries = cut(by_need.mapInArrow(_packer(QUERIES), _PACKED))
    by_length = rows.select("id", "x", F.lit(float("-inf")).alias("floor"), "_square").repartitionByRange(
        F.col("_square").desc(), F.xxhash64("id")).sortWithinPartitions(F.col("_square").desc(), "id")
    blocks = cut(by_length.mapInArrow(_packer(BLOCK), _PACKED))
    groups = max(1, -(-blocks.count() // GROUP))
    right = blocks.withColumn("_group", F.pmod(F.xxhash64("ids"), F.lit(groups))).select("_group", F.struct("longest", "n", "item", "ids", "x").alias("b"))
    left = queries.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).select(
        "_to", F.struct("least", "n", "item", "ids", "x", "floors").alias("a"))
    # the planner does not see that every block of queries goes to every group, nor how much work a pair is: it would
    # broadcast all the blocks of queries, or join groups to few tasks by their bytes
    left, right = left.repartition(groups, "_to"), right.repartition(groups, "_group")
    pairs = left.join(right.hint("merge"), (F.col("_to") == F.col("_group")) & (F.col("a.least") <= F.col("b.longest") * (1 + 1e-9))).select("a", "b")

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                a, b = (batch.column(c)[n].as_py() for c in ("a", "b"))
                (query_ids, x), (ids, y) = _unpacked(a, width), _unpacked(b, width)
                found = [(np.full(len(at), query_ids[i]), ids[at], score) for i, at, score in
                         block_pairs(x, query_ids, np.frombuffer(a["floors"]), y, ids, rotation, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return pairs.mapInArrow(run, "query_id long, id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")
