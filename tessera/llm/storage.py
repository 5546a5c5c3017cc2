"""Intermediate tables in the folder that all executors share.

The folder is the one named by ``spark.checkpoint.dir``.  Only a local session
may leave it unset: a folder of its warehouse is used then.  On a cluster a
missing setting is an error, since a machine-local folder would lose tables
with their executor.

An operator's result may read such tables when it is used, so they stay.  A
caller who is done with the result removes them by a scope::

    with scope(spark) as made:
        judge_urls(pages, rules).write.parquet(path)
        made.remove()
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class Scope:
    """The intermediate tables that one call has made, in order."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def remove(self, but: int = 0) -> None:
        """Delete the tables of this scope except the last ``but``; only for tables that no plan still to run reads."""
        gone = self.paths[: len(self.paths) - but]
        for path in gone:
            there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)
        del self.paths[: len(gone)]


#: The innermost open scope of this thread; other threads have their own.
_SCOPE: ContextVar[Scope | None] = ContextVar("tessera_scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Own the tables made inside the block, by this thread; what is left at its end goes to the scope around it."""
    around, own = _SCOPE.get(), Scope(spark)
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)
        if around is not None:
            around.paths += own.paths


def shared_folder(spark: SparkSession) -> str:
    """A new path, not yet created, below the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    if (own := _SCOPE.get()) is not None:
        own.paths.append(path)
    return path


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of ``df``.
    The shuffle files behind it are of no more use then and are deleted, not
    only when the driver happens to collect its garbage.
    """
    path = shared_folder(df.sparkSession)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_end(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _before, _lock = 0, None, threading.Lock()


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside delete their shuffle files at their end; the setting comes back with the last thread that leaves."""
    global _writing, _before
    with _lock:
        if not _writing:
            _before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writing += 1
    try:
        yield
    finally:
        with _lock:
            _writing -= 1
            if not _writing:
                spark.conf.unset(_CLEANUP) if _before is None else spark.conf.set(_CLEANUP, _before)


def drop_columns_clashing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names equal ``names`` in any case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
