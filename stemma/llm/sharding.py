"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.positions import with_positions
from stemma.shared import materialise


#: Buckets by which rows are ranked: least number, and rows of one, about.
LEAST_BUCKETS, BUCKET_ROWS = 4096, 100_000


def interleave(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Put every row into one of ``shards`` shards that all match the mixture of sources.

    Rows are shuffled within their source by the digest of seed and ``doc_id`` and
    ranked; row r of n has the fraction (r + 1/2) / n. All rows in the order of
    their fractions (then source) are cut into runs whose lengths differ by one at
    most. Returns doc_id, source, size, text_crc32, shard, slot.

    Ranks are taken in buckets (see ``with_positions``) of some ``BUCKET_ROWS`` rows at
    most, so a source with a third of all rows is no single task; only four short columns are moved, never a text.
    Null text: size 16 and the checksum of an empty text. Null source: a stratum of
    its own. Null doc_id: ranked like one more id. Repeated rows are separate rows;
    rows that agree in every column may change places, which shows nowhere. Empty
    table: empty result. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("stratum"),
        digest.alias("digest"),
    )
    rows = materialise(rows, "shard-rows")  # so that texts are read once
    buckets = max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS)
    digits = next(d for d in range(1, 16) if 16**d >= buckets)
    rows = rows.withColumn("bucket", F.conv(F.substring("digest", 1, digits), 16, 10).cast("long"))
    ties = ["doc_id", "text_crc32", "size"]
    ranked = with_positions(rows, ["stratum"], "bucket", ["digest", *ties], "rank", "of")
    fraction = (F.col("rank") + 0.5) / F.col("of")
    placed = with_positions(
        ranked.withColumn("fraction", fraction).withColumn("bucket", F.floor(F.col("fraction") * buckets)),
        [], "bucket", ["fraction", "stratum", "digest", *ties], "at", "n",
    )
    shard = F.expr(f"((at + 1) * {shards} - 1) div n")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"at - (shard * n) div {shards}").cast("long").alias("slot"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, whose row counts differ by one at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return interleave(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


#: The same law in DuckDB; the checksum runs over the bytes by the table of the reflected polynomial 0xEDB88320.
OP7_SQL = """
WITH tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)
), d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS stratum, hex(encode(coalesce(text, ''))) AS hx,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS digest
  FROM documents
), b AS (
  SELECT * EXCLUDE (hx), length(hx) // 2 + 16 AS size,
         list_transform(regexp_extract_all(hx, '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM d
), c AS (
  SELECT * EXCLUDE (bytes, t),
         xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32
  FROM b, tab
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id, text_crc32, size) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY stratum) AS fraction
  FROM c
), g AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, digest, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM r
), s AS (
  SELECT *, ((pos + 1) * 40 - 1) // n AS shard FROM g
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (pos - shard * n // 40)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard, source
FROM s
"""
