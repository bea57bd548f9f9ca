"""A generated collection, equal at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators.documents import build_documents

WORDS = (
    "river stone lantern harbour winter copper meadow thunder velvet orchard signal marble whisper canyon"
    " ember glacier saddle timber violet anchor barley compass drizzle feather granite hollow island juniper"
).split()


def _words(n: Column, seed: str) -> Column:
    """``n`` words drawn by the digest of the row's id, the seed and the place."""
    draw = lambda i: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64("doctype", "docid", F.lit(seed), i), F.lit(len(WORDS))) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), draw), " ")


def synthetic_documents(spark: SparkSession, doctypes: int = 10, docids: int = 20, longest: int = 5000) -> DataFrame:
    """``doctypes`` x ``docids`` documents; titles of 5 to 9 words, texts of 100 to ``longest`` + 99."""
    ids = spark.range(1, doctypes + 1).withColumnRenamed("id", "doctype").withColumn("docid", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(docids).cast("long"))))
    drawn = lambda seed, n: F.pmod(F.xxhash64("doctype", "docid", F.lit(seed)), F.lit(n))
    rows = ids.select("doctype", "docid", _words(5 + drawn("t", 5), "title").alias("title"), _words(100 + drawn("n", longest), "text").alias("text"))
    return build_documents(rows, F.col("doctype"), F.col("docid"), F.col("title"), F.col("text"))
