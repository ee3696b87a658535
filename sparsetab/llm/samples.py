"""Folds and bounded samples of labelled documents, for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % folds


def held_out(doc_id: str | Column, folds: int, fold_out: int) -> Column:
    """Whether a document is in the fold kept for evaluation; a null id is not."""
    return F.coalesce(fold(doc_id, folds) == fold_out, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold_out: int, rows: int) -> DataFrame:
    """At most ``rows`` documents with a label, drawn by hash of the id from all folds but one.

    Returns ``text`` and ``y`` (0.0 or 1.0).  The draw is made on the label table, which is then small whatever its
    size was: its bound is ``rows``, so it is broadcast.  Of rows that share an id one counts, that of the least text, so
    the bound holds for rows too.  Null ids, null labels and null texts are left out; of labels
    that contradict each other the larger counts.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out("doc_id", folds, fold_out)).groupBy("doc_id").agg(
        F.max(F.col(target)).cast("double").alias("y"))
    drawn = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where(F.col("text").isNotNull()).groupBy("doc_id", "y").agg(
        F.min("text").alias("text")).select("doc_id", "text", "y")
