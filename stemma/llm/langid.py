"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.texts import map_arrow
from stemma.shared import materialise, spread

#: Hashed features of byte n-grams, one to four bytes long, of lower-cased letters and single spaces.
FEATURES = 1 << 12
ORDERS = (1, 2, 3, 4)
#: Labelled documents of a language that its centroids are fitted on at most, and how many centroids.
SAMPLE, CENTROIDS = 400, 4
ROUNDS = 8
#: Of the training texts of a language this part is more similar to its centroids than the limit of rejection.
INSIDE = 0.995

_PIECE = 1 << 20


#: ASCII other than letters becomes a space.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _letters(text: str | None) -> bytes:
    """A text in lower case with runs of other ASCII as one space; empty without letters."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def counts_of(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text; None if it has no letter."""
    kept = _letters(text)
    if not kept:
        return None
    data = np.frombuffer(b" " + kept + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, len(data), _PIECE):
        part = data[at : at + _PIECE + max(ORDERS) - 1]
        gram = np.zeros(len(part), np.uint32)
        for n in ORDERS:
            gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :] if n > 1 else part
            gram_hash = ((gram + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
            counts += np.bincount(gram_hash[:_PIECE], minlength=FEATURES)
    return counts


@dataclass
class Centroids:
    """A fitted model: inverse document frequencies, unit centroids and their languages."""

    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    limits: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / (np.sqrt((v * v).sum()) or 1.0)

    def best(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """Language of the nearest centroid, the cosine, and whether that is too far away."""
        cosines = self.centres @ self.vector(counts)
        at = int(cosines.argmax())
        language = int(self.owner[at])
        score = float(min(1.0, max(0.0, cosines[at])))
        return self.languages[language], score, score < self.limits[language]


def _clustered(vectors: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means from farthest-first starts; no chance involved."""
    mean = vectors.sum(axis=0)
    centres = [mean / (np.linalg.norm(mean) or 1.0)]
    while len(centres) < min(k, len(vectors)):
        near = (vectors @ np.array(centres).T).max(axis=1)
        if near.min() > 1 - 1e-9:
            break
        centres.append(vectors[int(near.argmin())])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.array([vectors[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature is found, over all rows; summed by task, then in Spark."""

    def run(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = counts_of(text)
                if counts is not None:
                    total += counts > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["feature", "texts"])

    rows = map_arrow(docs.select("text"), run, "feature int, texts long").groupBy("feature").agg(F.sum("texts").alias("texts")).collect()
    found = np.zeros(FEATURES + 1, np.int64)
    for r in rows:
        found[r["feature"] + 1] = r["texts"]
    return found[1:], int(found[0])


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids:
    """Learn from the columns text and lang of training documents with an id.

    Document frequencies cover all texts. Every language of a text with letters has
    centroids, fitted in executors, one language at a time, on at most ``sample`` of
    its texts, those lowest by digest of the id; only the centroids are collected.
    """
    usable = docs.where(F.col("lang").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id"))
    ids = usable.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= sample)
    ids = materialise(ids.select(F.col("doc_id").alias("id"), F.col("lang").alias("language")), "language-sample")
    chosen = usable.join(ids, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("language"))).select("lang", "text")

    def run(batches):
        for batch in batches:
            made = [(lang, c) for lang, c in zip(batch.column(0).to_pylist(), map(counts_of, batch.column(1).to_pylist())) if c is not None]
            packed = [np.minimum(c, 65535).astype("<u2").tobytes() for _, c in made]
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in made], pa.string()), pa.array(packed, pa.binary())], names=["lang", "counts"])

    frequency, n = document_frequencies(usable)
    idf = np.log((1 + n) / (1 + frequency)) + 1

    def fitted(rows: pa.Table) -> pa.Table:
        unit = Centroids([], idf, np.empty((0, FEATURES)), np.empty(0, np.int64), np.zeros(0))
        vectors = np.array([unit.vector(np.frombuffer(c, "<u2")) for c in sorted(rows.column("counts").to_pylist())])
        found = _clustered(vectors, centroids)
        limit = np.quantile((vectors @ found.T).max(axis=1), 1 - INSIDE)
        return pa.table({"lang": rows.column("lang")[:1], "centres": pa.array([found.astype("<f4").tobytes()], pa.binary()), "limit": pa.array([limit], pa.float64())})

    made = map_arrow(chosen, run, "lang string, counts binary").groupBy("lang").applyInArrow(fitted, "lang string, centres binary, limit double")
    rows = sorted(made.collect(), key=lambda r: r["lang"])
    centres = [np.frombuffer(r["centres"], "<f4").reshape(-1, FEATURES) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in centres])
    return Centroids([r["lang"] for r in rows], idf, np.concatenate(centres) if rows else np.empty((0, FEATURES)), owner, np.array([r["limit"] for r in rows]))


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected) for all documents.

    A null text, one without letters, and any text if nothing was learned, is
    ``und`` with score 0. ``rejected`` marks texts farther from every centroid of
    their language than almost all of its training texts; they keep the prediction.
    Null doc_id: not held out. Repeated rows: each its own. Empty table: empty
    result. Only doc_id (for held_out) and text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    learned = len(model.languages) > 0

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                counts = counts_of(text) if learned else None
                out.append(("und", 0.0, True) if counts is None else model.best(counts))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.float64(), pa.bool_()))] if out else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id")))))
