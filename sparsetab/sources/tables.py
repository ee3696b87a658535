"""Result tables on shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_results(trials: DataFrame, path: str, partitions: Sequence[str] = ("exp", "trial"), mode: str = "append") -> None:
    """S8, S9. Results laid out by experiment and trial (or method).

    Rows are first gathered by partition value, so each folder gets few files;
    the rebalance hint lets adaptive execution split a value that has most rows.
    """
    parts = list(partitions)
    trials.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts).parquet(path)


def read_results(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """S8. All results, or those of the partitions ``where`` names."""
    table = spark.read.parquet(path)
    return table.filter(where) if where else table
