"""Filters, joins, set operations and aggregates on plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sparsetab.functions.scalar import NO_ENTREZ_FOUND, NO_GENE_FOUND

#: Rows that a task sorts or holds in a hash table at once, on average.
TASK_ROWS = 1 << 19


def drop_self_loops(edges: DataFrame) -> DataFrame:
    """P3."""
    return edges.filter(F.col("src") != F.col("dst"))


def constant_columns(cells: DataFrame) -> DataFrame:
    """P4. Columns that are zero in every row (mean 0 and deviation 0)."""
    stats = cells.groupBy("col_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")
    )
    return stats.filter((F.col("mean") == 0.0) & (F.col("sd") == 0.0)).select("col_id")


def large_columns(cells: DataFrame, threshold: float = 0.2) -> DataFrame:
    """P5. Columns with any absolute value above ``threshold``."""
    peak = cells.groupBy("col_id").agg(F.max(F.abs("value")).alias("peak"))
    return peak.filter(F.col("peak") > threshold)


def rows_below_mean(df: DataFrame, key: str, value: str, limit: float = 1e-3) -> DataFrame:
    """P6. Keys whose mean ``value`` is below ``limit``.

    Values are added up as decimal numbers where they have at most 12 decimals, so neither the mean nor the comparison
    depends on the order of rows; keys with other values get the mean of floating-point numbers.
    """
    exact = F.expr(f"try_cast({value} as decimal(28, 12))")
    plain = F.every(F.col(value).isNull() | F.equal_null(exact.cast("double"), F.col(value)))
    sums = df.groupBy(key).agg(F.sum(exact).alias("_sum"), F.avg(value).alias("mean"), F.count(value).alias("_n"), plain.alias("_plain"))
    told = F.col("_plain") & F.col("_sum").isNotNull()
    below = F.when(told, F.col("_sum") < F.lit(Decimal(repr(limit))) * F.col("_n")).otherwise(F.col("mean") < limit)
    mean = F.when(told, F.col("_sum").cast("double") / F.col("_n")).otherwise(F.col("mean"))
    return sums.filter(below).select(key, mean.alias("mean"))


def edges_within(edges: DataFrame, nodes: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """J2, G4. Edges with both ends in ``nodes``; ``on`` names further shared keys."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(*on, F.col("node").alias(end)), [*on, end], "left_semi")
    return edges


def symmetric(edges: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """J9. Each undirected edge in both directions, without duplicates."""
    there = edges.select(*on, "src", "dst")
    back = edges.select(*on, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return there.unionByName(back).distinct()


def first_match(wanted: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """J5. First name of every id that occurs in a second list.

    ``wanted(entrez)``, ``names(entrez, name, pos)``, ``known(name)``.  An id
    without names and an id without a known name get their fixed labels.
    """
    flagged = names.join(known.select("name").distinct().withColumn("_known", F.lit(True)), "name", "left")
    best = flagged.groupBy("entrez").agg(
        F.min_by(F.when(F.col("_known"), F.col("name")), F.when(F.col("_known"), F.col("pos"))).alias("_name")
    ).withColumn("_named", F.lit(True))
    label = (
        F.when(F.col("_named").isNull(), NO_ENTREZ_FOUND)
        .when(F.col("_name").isNull(), NO_GENE_FOUND)
        .otherwise(F.col("_name"))
    )
    return wanted.join(best, "entrez", "left").select("entrez", label.alias("name"))


def parameter_grid(df: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """J6. Every row of ``df`` at every point of a small literal grid."""
    for name, points in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in points])))
    return df


def reindex_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """J7. Both ends of every edge replaced by ``ids(node, new_id)``."""
    for end in ("src", "dst"):
        renamed = ids.select(F.col("node").alias(end), F.col("new_id").alias(f"new_{end}"))
        edges = edges.join(renamed, end)
    return edges.drop("src", "dst").withColumnsRenamed({"new_src": "src", "new_dst": "dst"})


def restrict_groups(groups: DataFrame, columns: DataFrame) -> DataFrame:
    """J8. Group members among the surviving columns.

    ``columns(col_id, new_col)``.  Groups left empty vanish; the original group
    id stays next to the new column position.
    """
    return groups.join(columns, "col_id").select("group_id", "col_id", "new_col")


def merge_result_tables(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """J10. Results of two method families side by side; missing cells stay null."""
    return left.join(right, list(on), "full_outer")


def l2_distance(a: DataFrame, b: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """A1. Norm of ``a - b`` per key; entries absent on one side count as 0."""
    diff = (
        a.select(*keys, index, F.col(value).alias("_d"))
        .unionByName(b.select(*keys, index, (-F.col(value)).alias("_d")))
        .groupBy(*keys, index).agg(F.sum("_d").alias("_d"))
    )
    return diff.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("norm"))


def sign_counts(weights: DataFrame, inside: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A4. Nonzeros and signs inside and outside a node set.

    ``weights(keys, node, w)``, ``inside(node)``.
    """
    flagged = weights.join(inside.select("node").distinct().withColumn("_in", F.lit(True)), "node", "left")
    here = F.col("_in").isNotNull()
    return flagged.groupBy(*keys).agg(
        F.count_if(F.col("w") != 0).alias("nonzero"),
        F.count_if(here & (F.col("w") < 0)).alias("nega_in"),
        F.count_if(~here & (F.col("w") < 0)).alias("nega_out"),
        F.count_if(here & (F.col("w") > 0)).alias("posi_in"),
        F.count_if(~here & (F.col("w") > 0)).alias("posi_out"),
    )


def prize_range(nodes: DataFrame, keys: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """A7. Least positive prize, floored at ``tol``, and the total."""
    return nodes.groupBy(*keys).agg(
        F.greatest(F.min(F.when(F.col("prize") > 0, F.col("prize"))), F.lit(tol)).alias("min_prize"),
        F.sum("prize").alias("total"),
    )


def projection_share(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A6, X13. Mean run time, mean projection time and their ratio."""
    return runs.groupBy(*keys).agg(
        F.avg("run_time").alias("run_time"),
        F.avg(F.col("head_time") + F.col("tail_time")).alias("projection_time"),
        (F.avg(F.col("head_time") + F.col("tail_time")) / F.avg("run_time")).alias("share"),
    )


def class_weights(rows: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """A9. Weight of a class is the share of the other class."""
    return rows.groupBy(*keys).agg(
        F.avg(F.when(F.col(y) < 0, 1.0).otherwise(0.0)).alias("cp"),
        F.avg(F.when(F.col(y) > 0, 1.0).otherwise(0.0)).alias("cn"),
        F.count(F.lit(1)).alias("n"),
    )


def union_supports(*supports: DataFrame, rows: int = 0) -> DataFrame:
    """U1. ``rows`` is about how many entries the supports have together, repeats included; 0 if that is not known."""
    both = reduce(DataFrame.unionByName, supports)
    return dealt(both, rows, *both.columns).distinct()


def same_support(a: DataFrame, b: DataFrame, keys: Sequence[str], index: str, rows: int = 0) -> DataFrame:
    """U3. Per key, whether two supports hold the same entries.

    Entries may repeat; ``rows`` is about how many there are, repeats included, 0 if that is not known.
    """
    marked = a.select(*keys, index, F.lit(1).alias("_s")).unionByName(b.select(*keys, index, F.lit(2).alias("_s")))
    both = dealt(marked, rows, *keys, index).groupBy(*keys, index).agg(F.bit_or("_s").alias("_s"))
    return both.groupBy(*keys).agg(F.every(F.col("_s") == 3).alias("equal"))


def merge_name_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """U4. Names of two sources under one id, first source first.

    Kept in long form ``(entrez, name, source, pos)``; ids of either source stay.
    """
    return first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row, such as a total, as scalar subqueries."""
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` to tasks of ``TASK_ROWS`` rows.

    The planner's shuffles have a fixed number of parts and are joined to parts of a size in bytes, compressed, so what a
    task holds grows with the table.  Here the number of tasks does.  Tables that fit a task are left to the planner.
    """
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)
