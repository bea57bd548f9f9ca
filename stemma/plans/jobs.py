"""The table of jobs: adding, deleting and associating documents, first in first out.

Rows: id, command, source_doctype, source_docid, source_range, target_range,
status, error, payload (gzip of the form-encoded body).
"""

from __future__ import annotations

import gzip
from urllib.parse import parse_qs, urlencode

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMMANDS = ("Add Document", "Delete Document", "Associate Document", "Test Corpus")
QUEUED, STARTED, COMPLETED, FAILED = "Queued", "Started", "Completed", "Failed"
STATUSES = "id long, nth long, status string, error string"
SCHEMA = "id long, command string, source_doctype long, source_docid long, source_range string, target_range string, status string, error string, payload binary"


def pack(values: dict[str, str | list[str]]) -> bytes:
    return gzip.compress(urlencode(values, doseq=True).encode(), 1)


def unpack(payload: bytes | None) -> dict[str, list[str]]:
    return parse_qs(gzip.decompress(bytes(payload)).decode(), keep_blank_values=True) if payload else {}


def numbered(queue: DataFrame, items: DataFrame) -> DataFrame:
    """Items (columns of the table without id and status, in order of ``nth``) as queued jobs with the next ids."""
    last = queue.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = items.withColumn("id", F.row_number().over(Window.orderBy("nth")) + F.lit(last).cast("long")).drop("nth")
    return rows.withColumns({"status": F.lit(QUEUED), "error": F.lit(None).cast("string")}).select(*queue.columns)


def enqueue(queue: DataFrame, items: DataFrame) -> DataFrame:
    """The queue with new items at its end."""
    return queue.unionByName(numbered(queue, items))


def marks(statuses: DataFrame, results: dict[int, tuple[str, str | None]]) -> DataFrame:
    """Rows that move each job on to its own status and error."""
    last = statuses.agg(F.coalesce(F.max("nth"), F.lit(0))).first()[0]
    return statuses.sparkSession.createDataFrame([(i, last + 1, status, error) for i, (status, error) in results.items()], STATUSES)


def current(queue: DataFrame, statuses: DataFrame) -> DataFrame:
    """The queue with the last status of every job; a job that is completed shows no payload."""
    last = statuses.groupBy("id").agg(F.max_by(F.struct("status", "error"), "nth").alias("__last"))
    now = queue.join(last, "id", "left")
    moved = F.col("__last").isNotNull()
    now = now.withColumn("status", F.coalesce("__last.status", "status")).withColumn("error", F.when(moved, F.col("__last.error")).otherwise(F.col("error")))
    return now.withColumn("payload", F.when(F.col("status") != COMPLETED, F.col("payload"))).select(*queue.columns)


def listing(queue: DataFrame) -> DataFrame:
    """All jobs in order, without their payload."""
    return queue.drop("payload").orderBy("id")


def item(queue: DataFrame, id: int) -> DataFrame:
    return queue.where(F.col("id") == id).drop("payload")


def next_batch(queue: DataFrame, limit: int = 10) -> DataFrame:
    """Of the first ``limit`` queued jobs those up to the first change of command."""
    first = queue.where(F.col("status") == QUEUED).orderBy("id").limit(limit)
    order = Window.orderBy("id")
    changed = F.max((F.col("command") != F.first("command").over(order)).cast("int")).over(order)
    return first.withColumn("changed", changed).where(F.col("changed") == 0).drop("changed").orderBy("id")


def set_status(queue: DataFrame, ids: list[int], status: str, error: str | None = None) -> DataFrame:
    """Move jobs on; a job that is completed keeps no payload."""
    mine = F.col("id").isin(ids)
    changed = queue.withColumn("error", F.when(mine, F.lit(error)).otherwise(F.col("error"))).withColumn("status", F.when(mine, F.lit(status)).otherwise(F.col("status")))
    return changed.withColumn("payload", F.when(mine & (F.lit(status) == COMPLETED), F.lit(None).cast("binary")).otherwise(F.col("payload")))


def stats(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def location(queue: DataFrame) -> DataFrame:
    """Where the result of each completed addition is."""
    done = queue.where((F.col("status") == COMPLETED) & (F.col("command") == COMMANDS[0]))
    return done.select("id", F.format_string("/document/%d/%d/", "source_doctype", "source_docid").alias("location"))
