"""Documents from feeds of events, by Structured Streaming.

A feed is a folder of JSON lines ``{"event_id": ..., "doctype": ..., "data": "{...}"}``
to which files are added; where a reader was is kept in the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemma.operators.documents import build_documents

EVENT = "event_id long, doctype long, data string"


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed settings (name, doctype, url, lastEventId) from a JSON list."""
    return spark.read.option("multiLine", True).schema("name string, doctype long, url string, lastEventId string").json(path)


def event_documents(events: DataFrame) -> DataFrame:
    """Events with a payload that is a JSON object with title and text; others are left out.

    String fields other than these two go to ``meta``; lists are dropped.
    """
    fields = F.from_json("data", "map<string,string>")
    rows = events.where(F.length(F.trim("data")) > 0).select("event_id", "doctype", fields.alias("fields")).where(F.col("fields").isNotNull())
    plain = F.map_filter("fields", lambda k, v: ~k.isin("title", "text") & v.isNotNull() & ~v.startswith("["))
    rows = rows.select("event_id", "doctype", F.col("fields")["title"].alias("title"), F.col("fields")["text"].alias("text"), F.transform_values(plain, lambda k, v: F.array(v)).alias("meta"))
    return rows.where((F.length("title") > 0) & (F.length("text") > 0))


def numbered(new: DataFrame, known: DataFrame) -> DataFrame:
    """Give events of a batch the next docids of their type; events already known keep theirs.

    ``known`` has doctype, event_id, docid. So a batch that is replayed changes nothing.
    Of the known events only those from the batch's lowest id on are looked at; where
    ids rise, files of earlier ones are skipped by their statistics.
    """
    least = new.agg(F.min("event_id")).first()[0]
    late = known.where(F.col("event_id") >= F.lit(least)).select("doctype", "event_id")
    fresh = new.dropDuplicates(["doctype", "event_id"]).join(late, ["doctype", "event_id"], "left_anti")
    last = known.groupBy("doctype").agg(F.max("docid").alias("last"))
    rank = F.row_number().over(Window.partitionBy("doctype").orderBy("event_id"))
    return fresh.withColumn("nth", rank).join(last, "doctype", "left").withColumn("docid", F.coalesce("last", F.lit(0)) + F.col("nth")).drop("nth", "last")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 10) -> StreamingQuery:
    """Start a stream that appends the documents of new events to the Parquet table ``target``.

    It ends when all files present are read (trigger ``availableNow``).
    """
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).json(source)
    schema = "doctype long, event_id long, docid long, title string, text string, characters long, valid boolean, meta map<string,array<string>>"

    def keep(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.schema(schema).option("ignoreMissingFiles", True).parquet(target)
        rows = numbered(event_documents(batch), known)
        made = build_documents(rows.withColumnRenamed("meta", "own_meta"), F.col("doctype"), F.col("docid"), F.col("title"), F.col("text")).drop("meta")
        ids = rows.select("doctype", "docid", "event_id", F.col("meta"))
        made.join(ids, ["doctype", "docid"]).select("doctype", "event_id", "docid", "title", "text", "characters", "valid", "meta").write.mode("append").parquet(target)

    empty = spark.createDataFrame([], schema)
    empty.write.mode("append").parquet(target)
    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
