"""Document fingerprints by content-defined chunking."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.texts import map_arrow



@dataclass(frozen=True)
class Level:
    """Bytes of a chunk (at least, the size that normalisation aims at, at most), and how many
    high bits of the hash a boundary needs clear, before the normal size and after it."""

    least: int
    normal: int
    most: int
    strict: int
    loose: int


#: Every text has chunks of the coarse level; one of under ``SHORT`` bytes has fine ones beside.
COARSE, FINE = Level(32, 96, 512, 8, 5), Level(8, 24, 128, 6, 3)
SHORT = 2048
#: Bytes of text that one sorted block holds, about, and the most blocks.
BLOCK_BYTES = 16 << 20
MOST_BLOCKS = 100_000
ENTRY = 20

_GEAR = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' gears, each shifted by its age."""
    h = _GEAR[data]
    for age in (1, 2, 4, 8, 16):
        older = h[:-age] << np.uint32(age)
        h[age:] += older
    return h


def boundaries(data: bytes, level: Level = COARSE) -> list[int]:
    """The ends of all chunks of ``data``; they move with the content, not with its place.

    A chunk ends after the first byte whose hash has the required high bits clear:
    more of them before the normal size, fewer after it, so sizes keep near it.
    """
    n = len(data)
    if n <= level.least:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(data, np.uint8))
    at = np.flatnonzero(h < (1 << (32 - level.loose)))
    strict = (h[at] < (1 << (32 - level.strict))).tolist()
    least, normal, most = level.least, level.normal, level.most
    ends, start = [], 0
    for i, clear in zip((at + 1).tolist(), strict):
        while i - start > most:
            start += most
            ends.append(start)
        size = i - start
        if size >= normal or (clear and size >= least):
            ends.append(i)
            start = i
    while n - start > most:
        start += most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_set(data: bytes, level: Level = COARSE) -> dict[int, int]:
    """Digest to length of every different chunk."""
    made, start = {}, 0
    digest = xxhash.xxh3_64_intdigest
    for end in boundaries(data, level):
        made[digest(data[start:end])] = end - start
        start = end
    return made


def fingerprint(data: bytes) -> tuple[dict[int, int], dict[int, int] | None]:
    """The coarse chunks of a text, and the fine ones of a short text."""
    return chunk_set(data), chunk_set(data, FINE) if len(data) < SHORT else None


def render(levels: tuple[dict[int, int], dict[int, int] | None]) -> str:
    """The fingerprint as text: 16 hex digits of digest and 4 of length for each chunk, in order; fine ones after a slash."""
    return "/".join("".join(f"{d:016x}{n:04x}" for d, n in sorted(x.items())) for x in levels if x is not None)


def parse(text: str) -> tuple[dict[int, int], dict[int, int] | None]:
    made = []
    for part in text.split("/"):
        cut = (part[i : i + ENTRY] for i in range(0, len(part), ENTRY))
        made.append({int(c[:16], 16): int(c[16:], 16) for c in cut})
    return made[0], made[1] if len(made) > 1 else None


def containment(of: dict[int, int], inside: dict[int, int]) -> float:
    """Which part of a document, by length of its different chunks, another one contains."""
    if not of:
        return 0.0 if inside else 1.0
    return sum(n for d, n in of.items() if d in inside) / sum(of.values())


def likeness(of: tuple, inside: tuple) -> float:
    """Containment by fine chunks where both texts have them, else by coarse ones."""
    fine = of[1] is not None and inside[1] is not None
    return containment(of[fine], inside[fine])


def edited(text: str, following: str) -> str:
    """The text with its last half of code points replaced by as many of the following one's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (block, last, doc_id, text): blocks of rising doc_id, each with the row after its last.

    Bounds are values of doc_id at even ranks; the documents at a bound go into the
    block that they begin and, as ``last``, into the one before it (the first of
    all into the last block). One shuffle moves each text once; ids that repeat or
    are null stay together. Null ids come after all others.
    """
    spark = docs.sparkSession
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = int(min(MOST_BLOCKS, max(1, (size or 0) // BLOCK_BYTES), max(1, rows)))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = ids.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / blocks for i in range(blocks)], 10 * blocks)).first()
    bounds = sorted({found[0], *(found[1] or [])} - {None})
    schema = "block int, last boolean, doc_id long, text binary"
    if not bounds:
        return ids.select(F.lit(0).alias("block"), F.lit(False).alias("last"), "doc_id", F.col("text").cast("binary").alias("text")).repartition(1)
    edge = np.array(bounds, np.int64)

    def run(batches):
        for batch in batches:
            own = batch.column(0)
            block = np.where(own.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(edge, own.fill_null(0).to_numpy(), "right") - 1, len(edge) - 1)
            first = own.is_valid().to_numpy(zero_copy_only=False) & (edge[block] == own.fill_null(0).to_numpy())
            yield _rows(block, False, own, batch.column(1))
            again = np.flatnonzero(first)
            if len(again):
                yield _rows((block[again] - 1) % len(edge), True, own.take(pa.array(again)), batch.column(1).take(pa.array(again)))

    def _rows(block, last, ids, texts):
        names = ["block", "last", "doc_id", "text"]
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(np.full(len(block), last)), ids, texts], names=names)

    placed = map_arrow(ids.select("doc_id", F.col("text").cast("binary").alias("text")), run, schema)
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(parts, "block")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first as
    many (or all) of the next document in ascending doc_id, after the last the
    first. Likenesses are containments of the document's chunk set.

    Bytes that are no UTF-8 count as replacement marks. Null text counts as empty; an empty text has the empty fingerprint, contained
    in an empty one alone and containing nothing else. Rows of equal doc_id follow
    one another in the order of their texts; null ids come last. A table of one row
    is its own next. Empty table: empty result. Other columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, types)))

    def judged(before, after):
        doc_id, text, chunks = before
        other = edited(text, after[1]).encode()
        changed = fingerprint(other)
        return (doc_id, len(text), hashlib.sha256(other).hexdigest(), render(chunks), render(changed), likeness(chunks, changed), likeness(chunks, after[2]))

    def run(batches):
        held = first = None
        for batch in batches:
            out = []
            for block, last, doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                text = (data or b"").decode("utf-8", "replace")
                row = (doc_id, text, fingerprint(text.encode()))
                if held is None or held[0] != block:
                    # A block without a row after its last goes on at its own first.
                    if held is not None:
                        out.append(judged(held[1], first))
                    held, first = None, row
                else:
                    out.append(judged(held[1], row))
                # Of several rows at the bound only the first follows; the others are not the block's own.
                held = None if last else (block, row)
            if out:
                yield made(out)
        if held is not None:
            yield made([judged(held[1], first)])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    placed = in_order(docs).sortWithinPartitions("block", "last", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    return map_arrow(placed, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", rows=256)


def op6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined fingerprints of all documents and of their edited forms."""
    return fingerprint_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
