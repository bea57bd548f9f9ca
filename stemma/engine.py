"""The engine: a collection, its index and its jobs in one folder.

Every change is one layer of a ``Store``: what it adds, and the keys that it takes
away. Documents and their postings change together.
"""

from __future__ import annotations

import gzip
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.operators import associate as pairs
from stemma.operators import documents as docs
from stemma.operators import index as idx
from stemma.operators import search as srch
from stemma.functions.ranges import intervals, predicate
from stemma.plans import jobs
from stemma.plans.config import EngineConfig
from stemma.plans.store import Store
from stemma.sources.synthetic import synthetic_documents
from stemma.streaming import feeds, sse

_DOCUMENTS = "doctype long, docid long, title string, text string, characters long, valid boolean, meta map<string,array<string>>"
_POSTINGS = "hash long, doctype long, docid long"
_ASSOCIATIONS = "doctype long, docid long, other_doctype long, other_docid long, fragments array<struct<left:int,right:int,length:int,theme_id:long>>, fragment_count int"
_TABLES = {"documents": _DOCUMENTS, "postings": _POSTINGS, "associations": _ASSOCIATIONS, "queue": jobs.SCHEMA, "statuses": jobs.STATUSES, "themes": "theme_id long, text string", "cursors": "name string, nth long, last_event_id string"}
_KEYED = {"documents": ("gone", docs.KEY), "postings": ("gone", docs.KEY), "associations": ("associated", docs.KEY)}


class Engine:
    """Add, delete, list, search and associate documents kept under ``path``."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.store = Store(spark, self.path, _TABLES, _KEYED)

    def table(self, name: str) -> DataFrame:
        if name == "queue":
            return jobs.current(self.store.read("queue"), self.store.read("statuses"))
        return self.store.read(name)

    def drop(self) -> None:
        self.store.drop()

    # Documents.

    def add_documents(self, new: DataFrame) -> None:
        """Add documents; those with an id that is there already replace it."""
        new = new.dropDuplicates(docs.KEY).select(*docs.COLUMNS)
        self.store.commit({"documents": new, "gone": lambda kept: kept["documents"].select(*docs.KEY), "postings": lambda kept: idx.build_index(kept["documents"], self.config)})

    def delete_documents(self, ids: DataFrame) -> None:
        self.store.commit({"gone": ids.select(*docs.KEY).distinct()})

    def get_document(self, doctype: int, docid: int) -> DataFrame:
        return docs.get(self.table("documents"), doctype, docid)

    def list_documents(self, **options) -> tuple[DataFrame, int]:
        return docs.list_documents(self.table("documents"), **options)

    def test_corpus(self, doctypes: int = 10, docids: int = 20, longest: int = 5000) -> None:
        self.add_documents(synthetic_documents(self.spark, doctypes, docids, longest))

    # Feeds.

    def cursor(self, name: str) -> str | None:
        """The id of the last event that was kept of a feed."""
        row = self.table("cursors").where(F.col("name") == name).agg(F.max_by("last_event_id", "nth")).first()
        return row[0]

    def pull_feed(self, name: str, doctype: int, url: str, most: int = 1000, timeout: float = 5.0) -> int:
        """Add the documents of a feed's next events, at most ``most``; returns how many events came.

        Documents, postings and the feed's place are one change, so a pull that is
        lost is repeated whole and nothing comes twice.
        """
        came = sse.read(url, self.cursor(name), most, timeout)
        if not came:
            return 0
        rows = feeds.event_documents(self.spark.createDataFrame([(n, doctype, data) for n, (_, data) in enumerate(came)], feeds.EVENT))
        last = self.table("documents").where(F.col("doctype") == doctype).agg(F.coalesce(F.max("docid"), F.lit(0))).first()[0]
        nth = F.row_number().over(Window.orderBy("event_id")) + last
        rows = rows.withColumn("docid", nth).withColumnRenamed("meta", "own")
        made = docs.build_documents(rows, F.col("doctype"), F.col("docid"), F.col("title"), F.col("text"), own=F.col("own"))
        cursor = self.spark.createDataFrame([(name, self.table("cursors").count() + 1, came[-1][0])], _TABLES["cursors"])
        self.store.commit({"documents": made, "postings": lambda kept: idx.build_index(kept["documents"], self.config), "cursors": cursor})
        return len(came)

    def pull_feeds(self, path: str, most: int = 1000, timeout: float = 5.0) -> int:
        """``pull_feed`` for every feed of a JSON list of settings; a feed begins after its ``lastEventId`` at first."""
        came = 0
        for r in feeds.read_feeds(self.spark, path).collect():
            if r["lastEventId"] and self.cursor(r["name"]) is None:
                self.store.commit({"cursors": self.spark.createDataFrame([(r["name"], 0, r["lastEventId"])], _TABLES["cursors"])})
            came += self.pull_feed(r["name"], r["doctype"], r["url"], most, timeout)
        return came

    # Index and search.

    def list_index(self, start: int = 0, limit: int = 100) -> DataFrame:
        return idx.list_index(self.table("postings"), start, limit)

    def search(self, text: str, target: str | None = None, limit: int | None = 10) -> DataFrame:
        """Ranked documents with the fragments that they share with ``text``, best first."""
        srch.check_query(text, self.config)
        config = replace(self.config, limit=limit)
        query = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        return self._with_fragments(query, srch.search(query, self.table("postings"), config, target))

    def search_document(self, doctype: int, docid: int, target: str | None = None, limit: int | None = 10, exclude_self: bool = False) -> DataFrame:
        """``search`` for the text of a stored document, which is among the matches unless ``exclude_self``."""
        stored = self.get_document(doctype, docid).select("text").first()
        if stored is None:
            raise ValueError(f"no document {doctype}/{docid}")
        srch.check_query(stored["text"], self.config)
        query = self.spark.createDataFrame([(0, stored["text"], doctype, docid)], "query_id long, text string, own_doctype long, own_docid long")
        return self._with_fragments(query, srch.search(query, self.table("postings"), replace(self.config, limit=limit), target, exclude_self))

    def _with_fragments(self, queries: DataFrame, ranked: DataFrame) -> DataFrame:
        ranked = ranked.withColumn("right_id", F.xxhash64("doctype", "docid"))
        stored = self.table("documents").join(ranked.select(*docs.KEY).distinct(), docs.KEY, "left_semi").withColumn("id", F.xxhash64("doctype", "docid"))
        left, right = pairs.prepared(queries, "query_id"), pairs.prepared(stored, "id")
        wanted = ranked.select(F.col("query_id").alias("left_id"), "right_id")
        found = pairs.associations(pairs.associate(left, right, self.config, wanted))
        joined = ranked.join(found.withColumnRenamed("left_id", "query_id"), ["query_id", "right_id"])
        return joined.drop("right_id").orderBy("query_id", "rank")

    # Associations: one join over all sources, not a loop.

    def associate(self, source: str | None = None, target: str | None = None, limit: int | None = None, exclude_self: bool = True) -> None:
        """Search every document of the source range and keep the associations, replacing earlier ones."""
        sources = self.table("documents").where(predicate(source))
        queries = sources.select(F.xxhash64("doctype", "docid").alias("query_id"), "text", F.col("doctype").alias("own_doctype"), F.col("docid").alias("own_docid"))
        ranked = srch.search(queries, self.table("postings"), replace(self.config, limit=limit), target, exclude_self)
        found = self._with_fragments(queries, ranked).join(queries.drop("text"), "query_id")
        new = found.select(F.col("own_doctype").alias("doctype"), F.col("own_docid").alias("docid"), F.col("doctype").alias("other_doctype"), F.col("docid").alias("other_docid"), "fragments", "fragment_count")
        self.store.commit({"associated": sources.select(*docs.KEY), "associations": new})

    def save_themes(self, found: DataFrame) -> None:
        """Keep the texts of fragments, each theme once."""
        new = found.select("theme_id", "text").dropDuplicates(["theme_id"])
        self.store.commit({"themes": new.join(self.table("themes").select("theme_id"), "theme_id", "left_anti")})

    def list_associations(self, source: str | None = None, target: str | None = None) -> DataFrame:
        return self.table("associations").where(predicate(source) & predicate(target, "other_doctype"))

    # Jobs.

    def enqueue(self, command: str, doctype: int | None = None, docid: int | None = None, source: str = "", target: str = "", values: dict | None = None) -> int:
        """Queue a job and return its id."""
        if command not in jobs.COMMANDS:
            raise ValueError(f"no such command: {command!r}")
        row = (0, command, doctype, docid, source, target, bytearray(jobs.pack(values)) if values else None)
        items = self.spark.createDataFrame([row], "nth int, command string, source_doctype long, source_docid long, source_range string, target_range string, payload binary")
        new = jobs.numbered(self.store.read("queue"), items)
        self.store.commit({"queue": new})
        return new.first()["id"]

    def queue(self) -> DataFrame:
        return jobs.listing(self.table("queue"))

    def queue_item(self, id: int) -> DataFrame:
        """One job, with the place of its result once it is completed."""
        return jobs.item(self.table("queue"), id).join(jobs.location(self.table("queue")), "id", "left")

    def queue_stats(self) -> DataFrame:
        return jobs.stats(self.table("queue"))

    def run_jobs(self) -> dict[str, int]:
        """Run queued jobs, a batch of one command at a time, until none is left; returns how many ended how.

        Every job of a batch has its own result: one that cannot be carried out fails
        with its own error, and the others are carried out together.
        """
        ended = {jobs.COMPLETED: 0, jobs.FAILED: 0}
        while batch := jobs.next_batch(self.table("queue")).collect():
            self._mark({r["id"]: (jobs.STARTED, None) for r in batch})
            errors = self._execute(batch)
            results = {r["id"]: (jobs.FAILED, errors[r["id"]]) if r["id"] in errors else (jobs.COMPLETED, None) for r in batch}
            self._mark(results)
            for status, _ in results.values():
                ended[status] += 1
        return ended

    def _mark(self, results: dict[int, tuple[str, str | None]]) -> None:
        self.store.commit({"statuses": jobs.marks(self.store.read("statuses"), results)})

    def _execute(self, batch: list) -> dict[int, str]:
        """Carry out jobs of one command; returns the errors by id."""
        command, errors, good = batch[0]["command"], {}, {}
        for r in batch:
            try:
                good[r["id"]] = (r, self._checked(r))
            except (ValueError, OSError, EOFError) as why:
                errors[r["id"]] = str(why)[:500]
        if not good:
            return errors
        try:
            if command == jobs.COMMANDS[0]:
                rows = {(r["source_doctype"], r["source_docid"]): made for r, made in good.values()}
                self.add_documents(self.spark.createDataFrame(list(rows.values()), _DOCUMENTS))
            elif command == jobs.COMMANDS[1]:
                self.delete_documents(self.spark.createDataFrame([(r["source_doctype"], r["source_docid"]) for r, _ in good.values()], "doctype long, docid long"))
            elif command == jobs.COMMANDS[2]:
                for source, target in dict.fromkeys((r["source_range"], r["target_range"]) for r, _ in good.values()):
                    self.associate(source, target)
            else:
                self.test_corpus()
        except Exception as why:  # what was carried out together fails together; the queue goes on
            errors |= {i: str(why)[:500] for i in good}
        return errors

    def _checked(self, job) -> tuple | None:
        """What a job needs, or an error that is its own."""
        if job["command"] == jobs.COMMANDS[2]:
            intervals(job["source_range"]), intervals(job["target_range"])
        if job["command"] in jobs.COMMANDS[:2] and min(job["source_doctype"] or 0, job["source_docid"] or 0) < 1:
            raise ValueError("doctype and docid must be 1 or more")
        if job["command"] != jobs.COMMANDS[0]:
            return None
        try:
            values = jobs.unpack(job["payload"])
        except (gzip.BadGzipFile, EOFError, UnicodeDecodeError) as why:
            raise ValueError(f"the payload cannot be read: {why}") from why
        title, text = (values.pop(k, [""])[0] for k in ("title", "text"))
        if not title or not text:
            raise ValueError("title and text are needed")
        return (job["source_doctype"], job["source_docid"], title, text, len(text), True, values)
