"""Cutting lineage in iterative jobs.

The state of a loop is written as a table to the folder all executors share, so
a lost executor costs a re-read and not a replay of the loop.  The folder is
the one the cluster names in ``spark.checkpoint.dir``; a private one is made
only where that setting is absent and the session is local.

A written table also carries its true size.  A checkpointed DataFrame keeps the
size estimate of the plan it came from, and in a loop of joins these estimates
multiply from round to round until planning takes longer than the work.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_private: dict[str, str] = {}
_folders: list[str] = []
_written: WeakKeyDictionary[DataFrame, list[str]] = WeakKeyDictionary()  # and the folders they are in


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _private:
        _private[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _private[context.applicationId]


@contextmanager
def folder(name: str) -> Iterator[str]:
    """Tables cut inside go to a folder of their own, so that ``clear`` can take them away; gives its name to ``clear``."""
    _folders.append(name)
    try:
        yield "/".join(_folders)
    finally:
        _folders.pop()


def clear(spark: SparkSession, name: str = "") -> None:
    """Deletes the intermediate tables of this session, or of one ``folder``; frames that read them must not be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(p for p in (shared_dir(spark), spark.sparkContext.applicationId, name) if p))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; the shuffles of the write are of no more use and leave the disks at once.

    A table that was cut in the same folder is not written again.
    """
    if _written.get(df) == _folders:
        return df
    spark = df.sparkSession
    path = "/".join([shared_dir(spark), spark.sparkContext.applicationId, *_folders, uuid.uuid4().hex])
    kept = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = [*_folders]
    return table


def cut_count(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows that meet ``condition``, counted while writing."""
    seen = Observation()
    table = cut(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return table, seen.get["n"]
