"""Mixing sources to target weights by weighted sampling without replacement.

DataFrame operations only.  Every document gets the exponential key of
Efraimidis and Spirakis, ``-ln(u) / w`` with ``u`` a hash of seed and document
and ``w`` its quality weight; in ascending order of the key the documents of a
source are a weighted sample without replacement.  Running sizes in that order
are cut at the source's budget.

A budget above the source's size is met by whole passes first; the rest is a
fractional pass over the order.  In the fractional pass a document is taken
whole if the larger part of it lies inside the budget, so a source misses its
target by at most half a document.

No window covers a source: sizes are summed by cell of the key first, the
cells of a source are added up in order, and running sums inside a cell finish
the job.  The number of cells of a source follows its number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORDS = r"[^\x20\x09-\x0D]+"
CELL_ROWS = 2000  # documents of a cell, about
CELLS_OF_CELLS = 1000  # cells that one running sum of cells covers


def n_words(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def uniform(seed: str, *columns: Column) -> Column:
    """A number in (0, 1) from a hash of the seed and columns; nulls count as a value of their own."""
    text = F.concat_ws("\u0001", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """Target of each source: the sum of all sizes shared by weight, no source above ``most`` times its size.

    ``sizes(source, source_size, ...)`` has one row per source.  Sources take ``weights`` in turn by code
    point, null last.  What exceeds a limit is shared again by weight until no source is above its limit.
    That ends where every free source gets ``level * weight``, so the limits are reached in ascending order
    of limit over weight, and the level follows from running sums in that order.  The windows here are over
    sources, not documents.  All sizes 0: all targets 0.  Adds ``weight`` and ``target``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    ratio = Window.orderBy("ratio", "turn")
    before, rest = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    table = sizes.withColumn("turn", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1),
    ).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    table = table.withColumn("total", F.sum("source_size").over(Window.partitionBy())).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source in order whose share is within its limit sets the level; sources before it are at their limits
    table = table.withColumn("free", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumn("target", F.when(level.isNull(), most * F.col("source_size")).otherwise(F.least(level * F.col("weight"), most * F.col("source_size")))).drop(
        "turn", "ratio", "total", "level", "free")


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, carry: tuple[str, ...] = (),
        tie: str | None = None) -> DataFrame:
    """How often each document is taken.

    ``docs(row, source, size, quality)``: a key of the document, its source, size >= 0 in words and quality weight.
    Returns those columns and the ones to ``carry``, with ``source_size``, ``target`` and ``copies`` (0 to ``most``).

    A document without a ``row`` draws by ``tie``, a column (a hash of its text, say) that tells such documents apart; without
    one they share a draw.  Null sources are one source.  A null quality, or one that is not positive, counts as 1.  Documents of size
    0 are in whole passes, and in a fractional pass where their place is.  Equal keys are ordered by ``row`` and
    size; which of several rows equal in both comes first makes no difference to the result as a whole.  An empty
    table gives no rows.  Cells are even where quality weights of a source lie within a factor of about ten.
    """
    drawn = F.col("row").cast("string") if tie is None else F.coalesce(F.col("row").cast("string"), F.concat(F.lit("\u0002"), F.col(tie).cast("string")))
    docs = docs.withColumn("_drawn", drawn).select("row", "source", "size", "quality", *carry, "_drawn")
    weight = F.when(F.col("quality") > 0, F.col("quality")).otherwise(1.0)
    keyed = docs.withColumn("_key", -F.log(uniform(seed, F.col("_drawn"))) / weight).drop("_drawn")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"), F.avg(weight).alias("_mean"))
    goal = targets(sizes, weights, float(most)).withColumn(
        "_whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)).withColumn(
        "_budget", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0))).withColumn(
        "_cells", F.ceil(F.col("_docs") / CELL_ROWS).cast("double")).withColumnRenamed("source", "_source").drop("weight", "_docs")
    # 1 - exp(-key * mean weight) rises with the key, and is uniform where all weights are equal
    cell = F.least(F.floor((1 - F.exp(-F.col("_key") * F.col("_mean"))) * F.col("_cells")), F.col("_cells") - 1).cast("long")
    placed = keyed.join(goal, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_cell", cell)

    cells = placed.groupBy("_source", "_cell").agg(F.sum("size").alias("_size"))
    wide = F.floor(F.col("_cell") / CELLS_OF_CELLS)
    by_wide = Window.partitionBy("_source").orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)
    wides = cells.groupBy("_source", wide.alias("_wide")).agg(F.sum("_size").alias("_size")).withColumn(
        "_base", F.coalesce(F.sum("_size").over(by_wide), F.lit(0))).select(F.col("_source").alias("_s"), F.col("_wide").alias("_w"), "_base")
    by_cell = Window.partitionBy("_source", "_wide").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_wide", wide).withColumn("_inner", F.coalesce(F.sum("_size").over(by_cell), F.lit(0))).join(
        wides, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_wide") == F.col("_w"))).select(
        F.col("_source").alias("_s"), F.col("_cell").alias("_c"), (F.col("_base") + F.col("_inner")).alias("_start"))

    within = Window.partitionBy("_source", "_cell").orderBy("_key", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    middle = F.col("_start") + F.col("_within") + F.col("size") / 2
    copies = F.col("_whole") + F.when(F.col("_whole") < most, (middle <= F.col("_budget")).cast("int")).otherwise(0)
    return ordered.select("row", "source", "size", "quality", *carry, "source_size", "target", copies.cast("long").alias("copies"))
