"""Feature groups and cross-validation splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparsetab.functions.scalar import hashed_unit
from sparsetab.operators.ranking import ranked
from sparsetab.operators.relational import attach_row


def edge_groups(nodes: DataFrame, edges: DataFrame, pairs: bool = True) -> DataFrame:
    """C1. Every node alone and, with ``pairs``, both ends of every edge."""
    single = nodes.select(F.array("node").alias("members"))
    if not pairs:
        return single
    return single.unionByName(edges.select(F.array("src", "dst").alias("members")).distinct())


def square_groups(cells: DataFrame, width: int, height: Column) -> DataFrame:
    """C2. 4-cycles of a lattice, one per top-left cell."""
    at = F.col("r") * width + F.col("c")
    inside = (F.col("c") + 1 < width) & (F.col("r") + 1 < height)
    return cells.filter(inside).select(F.array(at, at + 1, at + width, at + width + 1).alias("members"))


def pathway_groups(pathways: DataFrame, columns: DataFrame) -> DataFrame:
    """C3, J3. Members of every pathway among the measured columns, in long form."""
    return pathways.join(columns.select("entrez", "col_id"), "entrez").select(
        F.col("pathway_id").alias("group_id"), "col_id"
    ).distinct()


def member_lists(groups: DataFrame) -> DataFrame:
    """Members of every group as one array, for groups known to be small."""
    return groups.groupBy("group_id").agg(F.array_sort(F.collect_set("col_id")).alias("members"))


def singleton_groups(columns: DataFrame) -> DataFrame:
    """C4. Every column its own group (the plain lasso)."""
    return columns.select(F.col("col_id").alias("group_id"), "col_id")


def kfold(rows: DataFrame, k: int, order: Sequence[Column], strata: Sequence[str] = (), name: str = "fold") -> DataFrame:
    """C5, C6. Test fold of every row.

    Within a stratum the rows are put into the given order (a hash of the row,
    ending in a unique column); a fold holds ``round(n / k)`` rows and the last
    fold takes the rest.
    """
    strata = list(strata)
    placed = ranked(rows, strata, order, "_place", start=0)
    size = F.round(F.col("_n") / k).cast("long")
    fold = F.least(F.floor(F.col("_place") / F.greatest(size, F.lit(1))), F.lit(k - 1)).cast("int")
    if strata:
        counted = placed.join(placed.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")), strata)
    else:
        counted = attach_row(placed, placed.agg(F.count(F.lit(1)).alias("_n")))
    return counted.withColumn(name, fold).drop("_place", "_n")


def nested_folds(rows: DataFrame, k: int, sub_k: int, order: Sequence[Column], sub_order: Sequence[Column], strata: Sequence[str]) -> DataFrame:
    """C7. Outer folds and, on each outer training side, inner folds.

    Returns one row per row and outer fold it trains in, with its inner
    ``subfold``, and one row with null ``subfold`` for the fold it is tested in.
    """
    outer = kfold(rows, k, order, strata, "test_fold")
    every = outer.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    train = every.filter("fold <> test_fold").drop("test_fold")
    inner = kfold(train, sub_k, sub_order, ["fold", *strata], "subfold")
    test = every.filter("fold = test_fold").drop("test_fold").withColumn("subfold", F.lit(None).cast("int"))
    return inner.select(*test.columns).unionByName(test)


def contiguous_folds(rows: DataFrame, k: int, per_fold: int, row: str = "row_id") -> DataFrame:
    """C8. Consecutive test blocks of ``per_fold`` rows; rows beyond ``k`` blocks only train."""
    fold = F.floor(F.col(row) / per_fold)
    return rows.withColumn("fold", F.when(fold < k, fold).cast("int"))


def validation_split(rows: DataFrame, share: float, seed: int, keys: Sequence[str], row: str = "row_id") -> DataFrame:
    """C9. Disjoint training and validation rows of every trial, drawn by hash."""
    unit = hashed_unit(seed, *keys, row)
    return rows.withColumn("role", F.when(unit < share, "validation").otherwise("train"))
