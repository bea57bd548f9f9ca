"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and encoding.

Every stage works on all rows that its predecessor kept, and all but the last
return the columns of ``documents``, also further ones of any name.

Null, empty and blank texts have no words, so the first stage rejects them. A null
id: the row is judged by its text, takes no part in line dedup, names no component
and is one more document of the mix. A null source is a source of its own. Rows
that share an id: line dedup takes them for one document, and near-dedup keeps them
together. A text that line dedup empties has no shingles; of all such texts the
smallest id stays, with one copy in the mix and no ids at the end. Without labels
only the base rules reject. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import linededup, mixing, overlap, pieces, quality
from stemma.shared import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the list learned from ``labels`` keep."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a smaller doc_id has too."""
    return linededup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every component of texts with 0.8 or more of their five-word shingles in common.

    SimHash links over the pivot tables come first and are verified; an exact search
    finds the similar texts whose fingerprints lie too far apart.
    """
    return overlap.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their copies in the mix; a document may leave it."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document of the mix: doc_id, n_ids, ids, exact."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Learned rules, XXH64 votes and merges have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k}")
    return docs
