"""Tables that cut lineage, kept where every executor can read them.

Such tables are plain Parquet under ``spark.checkpoint.dir``; a lost executor
loses none of them. Only a session of one JVM may fall back to a temporary
folder; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that were written inside ``scratch``, by thread.
_SCRATCH: dict[int, list[str]] = {}
#: Whether Spark deletes the shuffle files of a statement as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; set here only where unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="stemma-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None, rows_per_file: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/stemma/{app}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    if get_ident() in _SCRATCH:
        _SCRATCH[get_ident()].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.materialised_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(table: DataFrame) -> None:
    """Delete one table that ``materialise`` wrote."""
    _delete(table.sparkSession, table.materialised_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that are materialised inside at the end, and shuffle files as soon as a table is written.

    Yields a function that excepts a table from this. What is read after the end,
    also by a lazy plan, may rest on such tables only. Not to be nested.
    """
    before, made, kept = spark.conf.get(_CLEANUP, None), _SCRATCH.setdefault(get_ident(), []), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.materialised_at)
        return table

    spark.conf.set(_CLEANUP, "true")
    try:
        yield keep
    finally:
        del _SCRATCH[get_ident()]
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
        for path in made:
            if path not in kept:
                _delete(spark, path)


def drop_materialised(spark: SparkSession) -> None:
    """Delete every table that this application wrote with ``materialise``."""
    _delete(spark, f"{shared_root(spark)}/stemma/{spark.sparkContext.applicationId}")


def spread(rows: DataFrame) -> DataFrame:
    """A table whose scan has fewer splits than there are cores, spread over all of them.

    Larger tables, whose scan keeps every core busy as it is, are left alone: no
    shuffle is added to them.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
