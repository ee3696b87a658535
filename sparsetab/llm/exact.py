"""Exact dedup with a heavy-hitter split.  DataFrame operations only.

Texts are equal when they are identical without white space (0x20 and 0x09 to 0x0D); a text is known by the SHA-256
of what is left.  Of equal texts the longest original stays, then the smallest id.

A digest that a third of all rows share must not meet in one task, so frequent digests are found first.  Spark's
``approx_top_k`` keeps a Misra-Gries summary (counters that are decreased when they run out); every task fills one
for each of ``SALTS`` shares of the digests, and the summaries of a share are merged.  The digests that come out are
candidates: at most ``SALTS * COUNTERS`` in all, whatever the size of the input.  A second pass counts their rows
exactly and finds their winners, pre-aggregated in each task.  These verified winners are broadcast (their bound is
that of the candidates) and their rows decided where they are read.  All other digests are rare, and go through an
ordinary shuffle.  Which digests are taken for frequent has no influence on the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsetab.lineage import cut

SPACES = " \t\n\x0b\x0c\r"
SALTS = 64  # shares of the digests, merged side by side
COUNTERS = 128  # of each summary; a digest in more than about one of 5000 rows is found


def digest(text: str | Column) -> Column:
    """SHA-256 of a text without white space, in lowercase hex; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, ""), 256)


def _code_points(text: str | Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def _keys(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Narrow table of id, digest and length, written once; ``row`` tells repeated ids apart."""
    return cut(docs.select(
        F.col(f"`{id}`").alias("doc_id"), digest(F.col(f"`{text}`")).alias("digest"), _code_points(F.col(f"`{text}`")).alias("points"),
        F.monotonically_increasing_id().alias("row")))


def candidates(keys: DataFrame) -> DataFrame:
    """Digests that may be frequent, at most ``SALTS * COUNTERS``."""
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).alias("salt")
    return keys.groupBy(salt).agg(F.expr(f"approx_top_k(digest, {COUNTERS}, {COUNTERS})").alias("top")).select(
        F.explode("top").alias("top")).select(F.col("top.item").alias("digest"))


def _order() -> Column:
    """The row that stays is the least in this order; null ids come last."""
    return F.struct((-F.col("points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")


def winners(keys: DataFrame) -> DataFrame:
    """Exact size and winner of each candidate: ``digest, group_size, best``."""
    heavy = keys.join(F.broadcast(candidates(keys)), "digest", "left_semi")
    return cut(heavy.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(_order()).alias("best")))


def mark(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row its group and whether it stays: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A null text counts as empty; empty texts and those of white space alone are one group.  Of rows equal in text,
    length and id exactly one has ``kept``.  A null id is larger than any other, and stays only if no other row of
    its group is as long; ``keep_id`` is then null.  Other columns of ``docs`` are ignored, whatever their names.
    An empty table gives no rows.
    """
    keys = _keys(docs, id, text)
    heavy = winners(keys)
    group = Window.partitionBy("digest")
    rare = keys.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").withColumns(
        {"group_size": F.count("*").over(group), "best": F.first(_order()).over(group.orderBy(_order()))})
    decided = keys.join(F.broadcast(heavy), "digest").unionByName(rare)
    return decided.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Losers of frequent digests go where they are read, so only texts of rare digests and a winner of each task are
    shuffled.  Of rows equal in text, length and id, which differ in other columns alone, one stays.
    """
    heavy = winners(_keys(docs, id, text)).select("digest", F.col("best.doc_id").alias("id"), (-F.col("best.shorter")).alias("points"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id}`").alias("id"), digest(F.col(f"`{text}`")).alias("digest"),
        _code_points(F.col(f"`{text}`")).alias("points"))
    winning = rows.join(F.broadcast(heavy.withColumnRenamed("id", "win_id")), ["digest", "points"]).where(
        F.col("id").eqNullSafe(F.col("win_id"))).groupBy("digest").agg(F.first("doc").alias("doc"))
    order = Window.partitionBy("digest").orderBy(F.col("points").desc(), F.col("id").asc_nulls_last())
    rare = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").withColumn("place", F.row_number().over(order)).where("place = 1")
    return winning.select("doc.*").unionByName(rare.select("doc.*"))
