"""Search: which documents share many windows with a text, best first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.ranges import predicate
from stemma.functions.text import normalise
from stemma.operators import blocks
from stemma.operators.documents import KEY
from stemma.operators.index import shard, shingles
from stemma.plans.config import EngineConfig


def check_query(text: str, config: EngineConfig) -> str:
    """A text given for a search must have a window at least."""
    if len(text) < config.window:
        raise ValueError(f"a text of a search needs {config.window} characters")
    return text


def hits(queries: DataFrame, postings: DataFrame, config: EngineConfig, target: str | None = None) -> DataFrame:
    """Every position of a query (columns query_id, text) with every document that holds its hash."""
    probes = shingles(queries, ["query_id"], config)
    held = postings.where(predicate(target))
    if config.max_docs_per_hash is not None:
        rare = held.groupBy("hash").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") <= config.max_docs_per_hash)
        held = held.join(rare.select("hash"), "hash", "left_semi")
    return probes.join(held, "hash")


def tallies(found: DataFrame, config: EngineConfig) -> DataFrame:
    """Count, sum and sum of squares of the steps between hits, by query, shard and document."""
    keys = ["query_id", "shard", *KEY]
    sharded = found.select("query_id", shard(config).alias("shard"), *KEY, F.col("pos").cast("long").alias("pos"))
    step = F.coalesce(F.col("pos") - F.lag("pos").over(Window.partitionBy(*keys).orderBy("pos")), F.lit(0))
    stepped = sharded.withColumn("step", step)
    return stepped.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum("step").alias("sum_deltas"), F.sum(F.col("step") * F.col("step")).alias("sum_square_deltas"))


OWN = ["own_doctype", "own_docid"]


def sides(queries: DataFrame, documents: DataFrame, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides of a search of texts in texts, packed."""
    keys = ["query_id", *(OWN if exclude_self else [])]
    normal = normalise(F.col("text")).alias("normal")
    return blocks.packed(queries.select(*keys, normal), keys, "queries", gather=True), blocks.packed(documents.select(*KEY, normal), KEY, "texts")


def own_rows(table) -> dict[tuple, list[int]]:
    """Of a block of queries the rows of each document that is one, by its key."""
    rows: dict[tuple, list[int]] = {}
    if OWN[0] in table.column_names:
        for i, key in enumerate(zip(*(table[c].to_pylist() for c in OWN))):
            rows.setdefault(key, []).append(i)
    return rows


def text_tallies(queries: DataFrame, documents: DataFrame, config: EngineConfig, target: str | None = None, exclude_self: bool = False) -> DataFrame:
    """The tallies of ``min_hits`` or more, of texts of which there is no index yet.

    A stored index is probed by ``hits``; here the hits, of which hashes that meet by
    chance make as many as there are pairs of windows for each hash, are counted
    where both texts are, and only strong tallies leave the task.
    """
    if config.max_docs_per_hash is not None:
        raise ValueError("hashes of many documents are dropped only from an index")
    names = ["query_id", "shard", *KEY, "count", "sum_deltas", "sum_square_deltas"]

    def begin(table):
        probes, ids, own = blocks.Probes(table["normal"].to_pylist(), config), table["query_id"].to_numpy(), own_rows(table)

        def step(texts):
            def parts():
                for doctype, docid, text in zip(*(texts[c].to_pylist() for c in (*KEY, "normal"))):
                    query, shard, *sums = probes.strong(text, own.get((doctype, docid)))
                    yield ids[query], shard, np.full(len(query), doctype), np.full(len(query), docid), *sums

            return blocks.gathered(parts(), names)

        return step

    ours, theirs = sides(queries, documents.where(predicate(target)), exclude_self)
    return blocks.crossed(ours, theirs, begin, ", ".join(f"{c} long" for c in names), "tallies")


def scored(parts: DataFrame, config: EngineConfig) -> DataFrame:
    """Merge the shards' strong enough tallies into mean, stddev and score; a lower score is better."""
    strong = parts.where((F.col("count") >= config.min_hits) & (F.col("sum_deltas") > 0))
    merged = strong.groupBy("query_id", *KEY).agg(*(F.sum(c).alias(c) for c in ("count", "sum_deltas", "sum_square_deltas")))
    mean = F.col("sum_deltas") / F.col("count")
    merged = merged.withColumn("mean", mean).withColumn("stddev", F.sqrt(F.greatest(F.col("sum_square_deltas") / F.col("count") - mean * mean, F.lit(0.0))))
    return merged.withColumn("score", F.col("stddev") / F.col("count"))


def search(queries: DataFrame, postings: DataFrame, config: EngineConfig, target: str | None = None, exclude_self: bool = False) -> DataFrame:
    """The best ``config.limit`` documents of each query with their ``rank`` from 1; ties by id.

    With ``exclude_self`` the queries carry doctype and docid of their own, as
    ``own_doctype`` and ``own_docid``, which are not matched.
    """
    matches = scored(tallies(hits(queries, postings, config, target), config), config)
    if exclude_self:
        own = queries.select("query_id", F.col("own_doctype").alias("doctype"), F.col("own_docid").alias("docid"))
        matches = matches.join(own, ["query_id", *KEY], "left_anti")
    return ranked(matches, config)


def search_texts(queries: DataFrame, documents: DataFrame, config: EngineConfig, target: str | None = None, exclude_self: bool = False) -> DataFrame:
    """``search`` in documents of which there is no index, with the same rows."""
    return ranked(scored(text_tallies(queries, documents, config, target, exclude_self), config), config)


def ranked(matches: DataFrame, config: EngineConfig) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", *KEY))
    made = matches.withColumn("rank", rank)
    return made if config.limit is None else made.where(F.col("rank") <= config.limit)
