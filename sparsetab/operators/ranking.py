"""Ranks, positions and top-k that hold up when one key owns most rows.

A plain ``row_number`` over a key sends the whole key to one task.  Here ranks
and running totals are found from range-partitioned runs, so a hot key is spread
over many tasks.  Top-k keeps the plain form where Spark's window group limit
drops all but k rows per key before the shuffle, that is up to the limit's own
threshold on k; a larger k takes ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsetab.lineage import cut



def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn", start: int = 1
) -> DataFrame:
    """W1, T3-T5. Exact position of every row within its key.

    ``order`` has to end in a unique column.  Rows are range-partitioned by key
    and order, so equal keys spill over as many partitions as they need; each
    run is numbered by itself and shifted by the size of the runs before it.
    """
    keys = list(keys)
    placed = cut(
        df.repartitionByRange(_partitions(df), *[F.col(k) for k in keys], *order)
        .withColumn("_run", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        placed.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    within = Window.partitionBy("_run", *keys).orderBy(*order)
    return (
        placed.withColumn("_pos", F.row_number().over(within))
        .join(shift, [*keys, "_run"])
        .withColumn(name, F.col("_pos") + F.col("_shift") + (start - 1))
        .drop("_run", "_pos", "_shift")
    )


def running_totals(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Sums over all smaller values of the key, as ``<name>_before`` columns.

    ``df`` holds one row per key and distinct value; it is written once, as it is
    small next to the data it was counted from.  Runs are those of ``ranked``:
    sums inside a run, and the totals of the runs of the key before it.
    """
    keys = list(keys)
    placed = cut(
        df.repartitionByRange(_partitions(df), *[F.col(k) for k in keys], F.col(value))
        .withColumn("_run", F.spark_partition_id())
    )
    over_runs = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_run").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = totals.select(*keys, "_run", *[F.coalesce(F.sum(f"_{c}").over(over_runs), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_run", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums])
        .join(earlier, [*keys, "_run"])
        .select(*df.columns, *[(F.col(f"_in_{c}") + F.col(f"_{c}")).alias(f"{c}_before") for c in sums])
    )


def dense_ids(df: DataFrame, key: str, name: str = "new_id") -> DataFrame:
    """W1. Distinct values of ``key`` numbered 0..k-1 in ascending order."""
    return ranked(df.select(key).distinct(), [], [F.col(key)], name, start=0)


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str | None = None
) -> DataFrame:
    """T2, T7. First ``k`` rows of every key; ``order`` has to end in a unique column."""
    rank = name or "_rank"
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        kept = ranked(df, keys, order, rank).filter(F.col(rank) <= k)
        return kept if name else kept.drop(rank)
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
    return kept if name else kept.drop(rank)


def by_magnitude(value: str, tie: str) -> list[Column]:
    """T4. Order of descending absolute value, ties by ``tie``."""
    return [F.abs(F.col(value)).desc(), F.col(tie)]


def hard_threshold(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, s: int, zero_rest: bool = False
) -> DataFrame:
    """T1. Keep the ``s`` entries of largest magnitude per key.

    By default the other entries are left out (zeros are not stored); with
    ``zero_rest`` they stay with value 0.
    """
    kept = top_k(df, keys, by_magnitude(value, tie), s)
    if not zero_rest:
        return kept
    flags = kept.select(*keys, tie, F.lit(True).alias("_kept"))
    return (
        df.join(flags, [*keys, tie], "left")
        .withColumn(value, F.when(F.col("_kept"), F.col(value)).otherwise(0.0))
        .drop("_kept")
    )


def trimmed_counts(df: DataFrame, keys: Sequence[str], value: str, ratio: float, half_up: bool = True) -> DataFrame:
    """W2. Symmetric trim, as one row per kept value with its multiplicity ``kept``.

    ``round(ratio * count)`` rows are dropped at each end of every key
    (``half_up=False`` cuts the fraction off instead).  Which of several equal
    values is dropped does not matter, so counts of values say all.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.groupBy(*keys).agg(F.sum("cnt").alias("total"))
    drop = F.round(F.col("total") * ratio) if half_up else F.floor(F.col("total") * ratio)
    placed = running_totals(counts, keys, value, ["cnt"]).join(
        total.withColumn("drop", drop.cast("long")), list(keys)
    )
    kept = F.least(F.col("cnt_before") + F.col("cnt"), F.col("total") - F.col("drop")) - F.greatest(
        F.col("cnt_before"), F.col("drop")
    )
    return placed.withColumn("kept", kept).filter("kept > 0").select(*keys, value, "kept")


def mean_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """W4. Mean rank of every distinct value; ties share the average rank."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    placed = running_totals(counts, keys, value, ["cnt"])
    return placed.withColumn("mean_rank", F.col("cnt_before") + (F.col("cnt") + 1) / 2).drop("cnt_before")


def padded_trace(trace: DataFrame, keys: Sequence[str], step: str, value: str, length: int) -> DataFrame:
    """W3. Ragged traces cut or padded with their last value to ``length`` steps."""
    keys = list(keys)
    known = trace.filter(F.col(step) < length).select(*keys, step, value)
    last = trace.groupBy(*keys).agg(
        F.max(step).alias("_last"), F.max_by(value, step).alias(value)
    ).filter(F.col("_last") < length - 1)
    padding = last.select(
        *keys, F.explode(F.sequence(F.col("_last") + 1, F.lit(length - 1).cast("long"))).alias(step), value
    )
    return known.unionByName(padding)


def kmers(chain: DataFrame, keys: Sequence[str], pos: str, value: str, k: int, all_lengths: bool = False) -> DataFrame:
    """W5. Windows of ``k`` consecutive chain members (with ``all_lengths`` also the shorter ones).

    Every member is sent to the at most ``k`` windows it lies in, so no task
    has to hold a chain.
    """
    keys = list(keys)
    lengths = F.sequence(F.lit(1 if all_lengths else k), F.lit(k))
    spread = (
        chain.select(*keys, F.col(pos).alias("_pos"), F.col(value).alias("_v"), F.explode(lengths).alias("len"))
        .select(*keys, "len", "_v", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("_o"), "_pos")
        .withColumn("start", F.col("_pos") - F.col("_o"))
    )
    return (
        spread.groupBy(*keys, "len", "start")
        .agg(F.array_sort(F.collect_list(F.struct("_o", "_v"))).alias("_m"))
        .filter(F.size("_m") == F.col("len"))
        .select(*keys, "len", "start", F.col("_m._v").alias("members"))
    )


def first_wins(df: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """W6. One row per key: the one that comes first by ``priority``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*priority)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
