"""Matrices as tables.

Two forms: long ``cells(row_id, col_id, value)`` for relational work, and
``rows(problem_id, row_id, x array<double>, y)`` for fitting.  Sums of vectors
and of outer products are taken per partition in Arrow batches and then added
up by key, so a shuffle carries one partial per partition and key, however many
rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sparsetab.functions.scalar import hashed
from sparsetab.operators.relational import attach_row

MAX_GRAM_COLUMNS = 5_000
_BUFFER_VALUES = 16_000_000  # doubles a task with several keys holds before it hands on partial sums


# -- long form ---------------------------------------------------------------

def to_cells(rows: DataFrame, keys: Sequence[str] = ("row_id",), x: str = "x") -> DataFrame:
    """Array rows to long form."""
    return rows.select(*keys, F.posexplode(x).alias("col_id", "value"))


def matvec(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """M1, E2. ``X w`` by row; ``weights(col_id, w)`` may omit zeros."""
    return cells.join(weights, "col_id").groupBy("row_id").agg(
        F.sum(F.col("value") * F.col("w")).alias("pred")
    )


def t_matvec(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """M2. ``X' v`` by column; ``vector(row_id, v)``."""
    return cells.join(vector, "row_id").groupBy("col_id").agg(
        F.sum(F.col("value") * F.col("v")).alias("total")
    )


def zscore(cells: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """M6. Columns to mean 0 and population deviation 1; constant columns to 0.

    ``fit_on`` holds the cells the mean and deviation are taken from.
    """
    stats = (fit_on if fit_on is not None else cells).groupBy("col_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")
    )
    scaled = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return cells.join(stats, "col_id").select("row_id", "col_id", scaled.alias("value"))


def unit_columns(cells: DataFrame, zero_eps: float = 1e-6) -> DataFrame:
    """M7. Centre and scale of every column; ``constant`` marks columns without spread."""
    stats = cells.groupBy("col_id").agg(
        F.avg("value").alias("mean"),
        (F.stddev_pop("value") * F.sqrt(F.count("value"))).alias("scale"),
    )
    return stats.withColumn("constant", F.col("scale") < zero_eps)


def scale_columns(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """M7. Cells centred and divided by the scale; constant columns are left out."""
    return cells.join(stats.filter(~F.col("constant")), "col_id").select(
        "row_id", "col_id", ((F.col("value") - F.col("mean")) / F.col("scale")).alias("value")
    )


def column_correlations(cells: DataFrame, response: DataFrame) -> DataFrame:
    """M8. Pearson correlation of every column with ``response(row_id, y)``."""
    return cells.join(response, "row_id").groupBy("col_id").agg(F.corr("value", "y").alias("r"))


def expand_groups(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """M9. One copy of a column for each group it belongs to."""
    return cells.join(groups, "col_id").select("row_id", "group_id", "col_id", "value")


def fold_back(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M9. Weight of a column as the sum over its copies."""
    return weights.groupBy(*keys, "col_id").agg(F.sum("w").alias("w"))


def restrict(cells: DataFrame, columns: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """M11. Matrix limited to a column set and a row set."""
    if columns is not None:
        cells = cells.join(columns.select("col_id"), "col_id", "left_semi")
    if rows is not None:
        cells = cells.join(rows.select("row_id"), "row_id", "left_semi")
    return cells


def group_gradient_norms(gradient: DataFrame, groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M13. Norm of the loss gradient on every feature group."""
    return gradient.join(groups, "col_id").groupBy(*keys, "group_id").agg(
        F.sqrt(F.sum(F.col("gradient") * F.col("gradient"))).alias("norm")
    )


def unpivot_measures(wide: DataFrame, ids: Sequence[str], values: str, measures: Sequence[str], offset: Column) -> DataFrame:
    """M14. Interleaved measures of successive samples to one row per sample.

    ``values`` is an array column holding ``len(measures)`` numbers per sample;
    ``offset`` is added to the sample number.
    """
    size = len(measures)
    sample = F.sequence(F.lit(0), F.floor(F.size(values) / size).cast("int") - 1)
    picked = [F.get(F.col(values), F.col("_s") * size + i).alias(m) for i, m in enumerate(measures)]
    return wide.withColumn("_s", F.explode(sample)).select(
        *ids, (F.col("_s") + offset).cast("int").alias("sample_id"), *picked
    )


# -- blocks ------------------------------------------------------------------

def row_blocks(rows: DataFrame, total: Column, b: Column, row: str = "row_id") -> DataFrame:
    """M4. Block number of every row; rows of the unfinished last block get null."""
    size = F.least(b, total)
    block = F.floor(F.col(row) / size)
    return rows.withColumn("block", F.when(block < F.floor(total / size), block))


def chosen_block(seed: int, epoch: Column, step: Column, num_blocks: Column, *keys: str) -> Column:
    """M5. Block drawn with replacement, the same on every run."""
    return F.pmod(hashed(seed, *keys, epoch, step), num_blocks)


# -- sums of vectors and outer products --------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(len(column), -1)


def _by_key(batch: pa.RecordBatch, keys: list[str]):
    if batch.num_rows == 0:
        return
    frame = batch.select(keys).to_pandas()
    for key, index in frame.groupby(keys, sort=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), index


def _parts(batch: pa.RecordBatch, keys: list[str]):
    """Each key of a batch with its rows as a matrix and their numbers; keys may differ in width."""
    arrays = batch.column("x")
    width = pc.list_value_length(arrays)
    even = pc.min(width).as_py() == pc.max(width).as_py()
    x = _matrix(arrays) if even else None
    for key, index in _by_key(batch, keys):
        yield key, x[index] if even else _matrix(arrays.take(pa.array(index))), index


def _emit(schema: pa.Schema, held: dict) -> pa.RecordBatch:
    keys = list(held)
    width = len(schema) - 1
    columns = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(width)]
    stacked = np.concatenate([held[k] for k in keys]) if keys else np.empty(0)
    offsets = np.concatenate([[0], np.cumsum([len(held[k]) for k in keys])]).astype("int32")
    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(stacked)))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _vector_sums(schema: pa.Schema, weighted: bool, in_order: bool):
    """Partition function: sum of (weighted) arrays per key.

    Unordered input is summed into a buffer that is handed on when full.
    Ordered input is complete per key, so a key leaves as soon as the next one starts.
    """
    keys = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = batch.column("v").to_numpy(zero_copy_only=False) if weighted else None
            for key, x, index in _parts(batch, keys):
                part = v[index] @ x if weighted else x.sum(axis=0)
                if key in held:
                    held[key] = held[key] + part
                else:
                    held[key] = part
            if in_order and len(held) > 1:
                open_key = _last_key(batch, keys)
                final = {k: s for k, s in held.items() if k != open_key}
                held = {open_key: held[open_key]}
                yield _emit(schema, final)
            elif not in_order and len(held) > 1 and sum(len(s) for s in held.values()) > _BUFFER_VALUES:
                yield _emit(schema, held)
                held = {}
        if held:
            yield _emit(schema, held)

    return run


def _last_key(batch: pa.RecordBatch, keys: list[str]) -> tuple:
    return tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)


def _outer_sums(schema: pa.Schema):
    """Partition function: sum of outer products per key, one output row per matrix row."""
    keys = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for key, x, _ in _parts(batch, keys):
                part = x.T @ x
                held[key] = held[key] + part if key in held else part
            if len(held) > 1 and sum(m.size for m in held.values()) > _BUFFER_VALUES:
                yield from _emit_rows(schema, held)
                held = {}
        yield from _emit_rows(schema, held)

    return run


def _emit_rows(schema: pa.Schema, held: dict) -> Iterator[pa.RecordBatch]:
    for key, matrix in held.items():
        yield _emit(schema, {(*key, i): row for i, row in enumerate(matrix)})


def _arrow_schema(df: DataFrame, keys: Sequence[str], *more: tuple[str, pa.DataType]) -> tuple[pa.Schema, str]:
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [(k, to_arrow_type(df.schema[k].dataType)) for k in keys] + list(more)
    ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return pa.schema(fields), ddl


def vector_sums(df: DataFrame, keys: Sequence[str], x: str = "x", v: Column | None = None) -> DataFrame:
    """M2. Sum of the arrays ``x``, each times ``v``, per key: ``(keys, sums)``."""
    keys = list(keys)
    schema, ddl = _arrow_schema(df, keys, ("sums", pa.list_(pa.float64())))
    ddl = f"{ddl}, sums array<double>"
    picked = df.select(*keys, F.col(x).alias("x"), *([v.alias("v")] if v is not None else []))
    partial = picked.mapInArrow(_vector_sums(schema, v is not None, False), ddl)
    return _add_up(partial, keys, schema, ddl)


def _add_up(partial: DataFrame, keys: list[str], schema: pa.Schema, ddl: str) -> DataFrame:
    gathered = partial.withColumnRenamed("sums", "x").repartition(*keys).sortWithinPartitions(*keys)
    return gathered.mapInArrow(_vector_sums(schema, False, True), ddl)


def gram(rows: DataFrame, keys: Sequence[str], x: str = "x", columns: int | None = None) -> DataFrame:
    """M3. ``sum of x x'`` per key, one row ``(keys, i, sums)`` for each matrix row.

    A task holds the whole matrix of a key while it sums, so matrices of more
    than ``MAX_GRAM_COLUMNS`` columns are summed by tiles (``tall.tiled_gram``);
    a caller who names ``columns`` asks for the plain form.
    """
    keys = list(keys)
    if columns is None:
        columns = rows.select(F.max(F.size(x))).first()[0] or 0
        if columns > MAX_GRAM_COLUMNS:
            from sparsetab.operators.tall import tiled_gram

            return tiled_gram(rows, keys, x)
    if columns > MAX_GRAM_COLUMNS:
        raise ValueError(f"{columns} columns are too many for a Gram matrix; fit without one")
    schema, ddl = _arrow_schema(rows, keys, ("i", pa.int32()), ("sums", pa.list_(pa.float64())))
    ddl = f"{ddl}, i int, sums array<double>"
    partial = rows.select(*keys, F.col(x).alias("x")).mapInArrow(_outer_sums(schema), ddl)
    return _add_up(partial, [*keys, "i"], schema, ddl)


def gram_cells(rows: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """M3. Gram matrix in long form ``(keys, i, j, value)``."""
    return gram(rows, keys, x).select(*keys, "i", F.posexplode("sums").alias("j", "value"))


# -- small dense algebra per key ---------------------------------------------

def solve_normal(system: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M10. Least squares from normal equations by pseudo-inverse.

    ``system(keys, idx, g, xty)`` has one row per kept column, ``g`` being that
    row of the Gram matrix over the kept columns in ascending ``idx``.  A key
    holds at most the support size squared, so it fits one task by contract.
    """
    keys = list(keys)
    ddl = ", ".join(f"`{k}` {system.schema[k].dataType.simpleString()}" for k in keys)

    def solve(frame):
        frame = frame.sort_values("idx")
        matrix = np.vstack(frame["g"].to_numpy())
        solution = np.linalg.pinv(matrix, rcond=1e-12, hermitian=True) @ frame["xty"].to_numpy()
        return frame[[*keys, "idx"]].assign(w=solution)

    return system.select(*keys, "idx", "g", "xty").groupBy(*keys).applyInPandas(solve, f"{ddl}, idx int, w double")


def trace_norms(gram_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """M12. Weight of a group: sum of singular values of its columns, largest scaled to 1.

    ``gram_rows(i, sums)`` is the Gram matrix of all columns; the square roots
    of the eigenvalues of a group's block are its singular values.
    """
    members = groups.groupBy("group_id").agg(F.array_sort(F.collect_set("col_id")).alias("cols"))
    block = (
        groups.join(members, "group_id").join(gram_rows.withColumnRenamed("i", "col_id"), "col_id")
        .select("group_id", "col_id", F.transform("cols", lambda c: F.get(F.col("sums"), c)).alias("g"))
    )

    def norm(frame):
        import pandas as pd

        frame = frame.sort_values("col_id")
        values = np.linalg.eigvalsh(np.vstack(frame["g"].to_numpy()))
        total = float(np.sqrt(np.clip(values, 0.0, None)).sum())
        return pd.DataFrame({"group_id": [frame["group_id"].iloc[0]], "norm": [total]})

    kind = groups.schema["group_id"].dataType.simpleString()
    sums = block.groupBy("group_id").applyInPandas(norm, f"group_id {kind}, norm double")
    peak = sums.agg(F.max("norm").alias("peak"))
    return attach_row(sums, peak).select("group_id", "norm", (F.col("norm") / F.col("peak")).alias("weight"))
