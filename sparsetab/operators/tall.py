"""Wide Gram matrices by tiles, and least squares and singular values of tall matrices by QR.

A Gram matrix squares the condition number; the triangular factor of a QR decomposition does not, and is as small.  Each
task factors its rows, a buffer at a time, and factors are merged two by two: first within shares of the tasks, then
over shares.  ``rows(keys, x array<double>)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsetab.operators.matrix import _arrow_schema, _by_key, _last_key, _parts
from sparsetab.operators.relational import attach_row

TILE = 1024  # columns of a tile
HELD = 1 << 24  # numbers of rows that a task holds before it hands on their products
SHARES = 32  # shares of the tasks whose factors are merged first


# -- Gram matrices of any width ------------------------------------------------------

def _products(schema: pa.Schema, tile: int, held: int):
    """Products of the column tiles of a task's rows, a pair of tiles a row, the smaller tile first."""
    keys = schema.names[:-4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        numbers = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for key, x, _ in _parts(batch, keys):
                kept.setdefault(key, []).append(x)
                numbers += x.size
            if numbers >= held:
                yield from out(kept)
                kept, numbers = {}, 0
        yield from out(kept)

    def out(kept: dict) -> Iterator[pa.RecordBatch]:
        for key, parts in kept.items():
            x = np.concatenate(parts)
            starts = range(0, x.shape[1], tile)
            for i, a in enumerate(starts):
                for j, b in enumerate(starts):
                    if j >= i:
                        left, right = x[:, a:a + tile], x[:, b:b + tile]
                        values = [*key, i, j, left.shape[1], (left.T @ right).ravel()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    return run


def _added(schema: pa.Schema):
    """Sums of products of equal key, which come one after another; pairs of tiles differ in size."""
    keys = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in keys]
            sums = batch.column("sums")
            for k, own in enumerate(zip(*columns)):
                part = sums.slice(k, 1).flatten().to_numpy(zero_copy_only=False)
                if own != key and total is not None:
                    yield row(key, total)
                key, total = own, part.copy() if own != key else total + part
        if total is not None:
            yield row(key, total)

    def row(key, total):
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, total), schema)], schema=schema)

    return run


def tiled_gram(rows: DataFrame, keys: Sequence[str], x: str = "x", tile: int = TILE, held: int = HELD) -> DataFrame:
    """M3. ``sum of x x'`` per key for any number of columns: ``(keys, i, sums)``, a row for each matrix row.

    A task multiplies the tiles of ``held`` numbers of rows at a time and hands on the upper triangle of products; pairs
    of tiles are added up by a shuffle.  The shuffle carries about ``columns ** 2 / (2 held)`` times the matrix.  A task
    holds a pair of tiles of the result, and a row of it when rows are put together.
    """
    keys = list(keys)
    schema, ddl = _arrow_schema(rows, keys, ("a", pa.int32()), ("b", pa.int32()), ("height", pa.int32()), ("sums", pa.list_(pa.float64())))
    partial = rows.select(*keys, F.col(x).alias("x")).mapInArrow(_products(schema, tile, held), f"{ddl}, a int, b int, height int, sums array<double>")
    own = [*keys, "a", "b", "height"]
    whole = partial.repartition(*own).sortWithinPartitions(*own).mapInArrow(_added(schema), f"{ddl}, a int, b int, height int, sums array<double>")
    row_schema, _ = _arrow_schema(rows, keys, ("i", pa.int32()), ("part", pa.int32()), ("segment", pa.list_(pa.float64())))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                a, b, height = (one.column(c)[0].as_py() for c in ("a", "b", "height"))
                block = one.column("sums").flatten().to_numpy().reshape(height, -1)
                for m, i, part in [(block, a, b)] + ([(block.T, b, a)] if a != b else []):
                    m = np.ascontiguousarray(m)
                    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
                    columns = [pa.array([one.column(c)[0].as_py()] * len(m), row_schema.field(c).type) for c in keys]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(np.arange(len(m), dtype=np.int32) + i * tile), pa.array(np.full(len(m), part, dtype=np.int32)),
                         pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], schema=row_schema)

    segments = whole.mapInArrow(lines, f"{ddl}, i int, part int, segment array<double>")
    return segments.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("part", "segment"))).alias("_s")).select(
        *keys, "i", F.flatten(F.col("_s.segment")).alias("sums"))


# -- triangular factors --------------------------------------------------------------

def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


def _factors(schema: pa.Schema, key_count: int, in_order: bool):
    """Triangular factor of each key's rows (or factors); ``in_order``: a key's rows come one after another."""
    keys = schema.names[:key_count]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column("x")
            for key, index in _by_key(batch, keys):
                part = flat.take(pa.array(index))
                width = batch.column("p")[int(index[0])].as_py()
                rows = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                for at in range(0, len(rows), max(4 * width, 1024)):
                    block = rows[at:at + max(4 * width, 1024)]
                    held[key] = _triangle([held[key], block]) if key in held else _triangle([block])
            if in_order and len(held) > 1:
                last = _last_key(batch, keys)
                yield out({k: r for k, r in held.items() if k != last})
                held = {last: held[last]}
        if held:
            yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([r.shape[1] for r in held.values()], pa.int32()), pa.array([r.ravel() for r in held.values()], pa.list_(pa.float64()))],
            names=[*keys, "p", "x"])

    return run


def triangular(rows: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Triangular factor ``R`` of the rows of each key, ``R'R = X'X``: ``(keys, p, x)`` with ``x`` the factor row by row.

    All rows of a key have one width.  A key with fewer rows than columns has a factor with as many rows.  A task holds
    a factor for each key it meets and a few thousand rows.
    """
    keys = list(keys)
    schema, ddl = _arrow_schema(rows, keys)
    start = rows.select(*keys, F.size(x).alias("p"), F.col(x).cast("array<double>").alias("x"))
    shape = f"{ddl}, p int, x array<double>"
    parts = start.mapInArrow(_factors(schema, len(keys), False), shape)
    shares = parts.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    shared_schema = pa.schema([*schema, pa.field("share", pa.int32())])
    merged = shares.select(*keys, "share", "p", "x").repartition(*keys, "share").sortWithinPartitions(*keys, "share").mapInArrow(
        _factors(shared_schema, len(keys) + 1, True), f"{ddl}, share int, p int, x array<double>")
    return merged.select(*keys, "p", "x").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_factors(schema, len(keys), True), shape)


def least_squares(rows: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", rcond: float = 1e-13) -> DataFrame:
    """M10. Least squares by QR: ``(keys, w array<double>, rank, rss)``.

    The factor of the columns with the response beside them holds all that is needed.  Directions whose singular value
    is at most ``rcond`` times the largest are left out, so the weights are those of least norm.
    """
    keys = list(keys)
    wide = rows.select(*keys, F.concat(F.col(x).cast("array<double>"), F.array(F.col(y).cast("double"))).alias("x"))
    schema, ddl = _arrow_schema(rows, keys)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, ranks, left = [], [], []
            for k in range(batch.num_rows):
                width = batch.column("p")[k].as_py()
                r = np.array(batch.column("x")[k].values).reshape(-1, width)
                u, sizes, v = np.linalg.svd(r[:, :-1], full_matrices=False)
                good = sizes > rcond * sizes.max(initial=0.0)
                w = v[good].T @ ((u[:, good].T @ r[:, -1]) / sizes[good])
                weights.append(w)
                ranks.append(int(good.sum()))
                left.append(float(((r[:, -1] - r[:, :-1] @ w) ** 2).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keys), pa.array(weights, pa.list_(pa.float64())), pa.array(ranks, pa.int32()), pa.array(left, pa.float64())],
                names=[*keys, "w", "rank", "rss"])

    return triangular(wide, keys).mapInArrow(solve, f"{ddl}, w array<double>, rank int, rss double")


def singular_values(rows: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Singular values of the rows of each key, largest first: ``(keys, values array<double>)``."""
    keys = list(keys)
    _, ddl = _arrow_schema(rows, keys)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.linalg.svd(np.array(v.values).reshape(-1, p.as_py()), compute_uv=False) for v, p in zip(batch.column("x"), batch.column("p"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(found, pa.list_(pa.float64()))], names=[*keys, "values"])

    return triangular(rows, keys, x).mapInArrow(values, f"{ddl}, `values` array<double>")


def trace_norms(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """M12. Weight of a group: sum of the singular values of its columns, largest scaled to 1.

    ``rows(x)``, ``groups(group_id, col_id)``.  Members are read from the rows as they pass; only a group's triangular
    factor comes together in a task, whatever the number of rows.
    """
    members = groups.groupBy("group_id").agg(F.array_sort(F.collect_set(F.col("col_id").cast("int"))).alias("cols"))
    lists = members.agg(F.collect_list(F.struct("group_id", "cols")).alias("lists"))
    parts = attach_row(rows.select("x"), lists).select("x", F.explode("lists").alias("g")).select(
        F.col("g.group_id").alias("group_id"), F.transform("g.cols", lambda c: F.get(F.col("x"), c)).alias("x"))
    sums = singular_values(parts, ["group_id"]).select("group_id", F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("norm"))
    peak = sums.agg(F.max("norm").alias("peak"))
    return attach_row(sums, peak).select("group_id", "norm", (F.col("norm") / F.col("peak")).alias("weight"))
