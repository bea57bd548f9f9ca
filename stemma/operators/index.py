"""The index: which documents hold which window hash, as a flat table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.hashing import exploded, window_hashes
from stemma.functions.text import normalise
from stemma.operators.documents import KEY
from stemma.plans.config import EngineConfig
from stemma.shared import materialise


def shingles(texts: DataFrame, keys: list[str], config: EngineConfig) -> DataFrame:
    """Every window of every text: keys, pos, hash."""
    window, width = config.window, config.hash_width

    def arrays(text: str):
        hashes = window_hashes(text, window, width)
        return np.arange(len(hashes), dtype=np.int32), hashes

    return exploded(texts.select(*keys, normalise(F.col("text")).alias("text")), keys, "text", arrays, [("pos", "int"), ("hash", "long")])


def build_index(documents: DataFrame, config: EngineConfig) -> DataFrame:
    """Postings (hash, doctype, docid), each once. Repeats go within the document, before any shuffle."""
    window, width = config.window, config.hash_width
    texts = documents.select(*KEY, normalise(F.col("text")).alias("text"))
    return exploded(texts, KEY, "text", lambda t: (np.unique(window_hashes(t, window, width)),), [("hash", "long")]).select("hash", *KEY)


def posting_counts(documents: DataFrame, config: EngineConfig) -> DataFrame:
    """How many postings ``build_index`` makes of each document that has any: doctype, docid, postings. None is made."""
    window, width = config.window, config.hash_width
    texts = documents.select(*KEY, normalise(F.col("text")).alias("text"))

    def count(text: str):
        n = len(np.unique(window_hashes(text, window, width)))
        return (np.full(min(n, 1), n, np.int64),)

    return exploded(texts, KEY, "text", count, [("postings", "long")])


def add_to_index(postings: DataFrame, documents: DataFrame, config: EngineConfig) -> DataFrame:
    """The index after documents are added or replaced; what they held before goes."""
    return delete_from_index(postings, documents).unionByName(build_index(documents, config))


def delete_from_index(postings: DataFrame, ids: DataFrame) -> DataFrame:
    return postings.join(ids.select(*KEY).distinct(), KEY, "left_anti").select("hash", *KEY)


def shard(config: EngineConfig) -> Column:
    """The highest bits of a hash, also where it has all 64."""
    bits = config.shards.bit_length() - 1
    return F.shiftrightunsigned("hash", config.hash_width - bits) if bits else F.lit(0).cast("long")


def _varint_bytes(value: Column) -> Column:
    return F.when(value < 1 << 7, 1).when(value < 1 << 14, 2).when(value < 1 << 21, 3).when(value < 1 << 28, 4).otherwise(5)


def posting_lines(postings: DataFrame) -> DataFrame:
    """One row for each hash: its document types with ids and their deltas, and the bytes of the packed line."""
    types = postings.groupBy("hash", "doctype").agg(F.array_sort(F.collect_set("docid")).alias("docids"))
    deltas = F.transform("docids", lambda d, i: F.when(i == 0, d).otherwise(d - F.get("docids", i - 1)))
    types = types.withColumn("deltas", deltas)
    size = F.aggregate("deltas", F.lit(0), lambda acc, d: acc + _varint_bytes(d))
    types = types.withColumn("bytes", _varint_bytes(F.col("doctype")) + _varint_bytes(size) + size)
    lines = types.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("doctype", "docids", "deltas"))).alias("doctypes"), (1 + F.sum("bytes")).cast("int").alias("bytes"))
    return lines.select("hash", "bytes", "doctypes")


def line_stats(postings: DataFrame, config: EngineConfig, full: int = 255) -> DataFrame:
    """By shard: lines, their bytes and postings, and how many lines and postings a store of lines of under ``full`` bytes could not hold."""
    earlier = F.lag("docid", 1, 0).over(Window.partitionBy("hash", "doctype").orderBy("docid"))
    sized = postings.withColumn("delta", F.col("docid") - earlier)
    types = sized.groupBy("hash", "doctype").agg(F.count(F.lit(1)).alias("n"), F.sum(_varint_bytes(F.col("delta"))).alias("size"))
    own = _varint_bytes(F.col("doctype")) + _varint_bytes(F.col("size")) + F.col("size")
    lines = types.groupBy("hash").agg((1 + F.sum(own)).alias("bytes"), F.sum("n").alias("n"))
    over = F.col("bytes") >= full
    made = lines.select(shard(config).alias("shard"), "bytes", "n").groupBy("shard").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"), F.sum("n").alias("postings"),
        F.count_if(over).alias("saturated"), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)).alias("ignored"),
    )
    return _with_percent(made)


def _with_percent(made: DataFrame) -> DataFrame:
    return made.withColumn("ignored_percent", F.round(100 * F.col("ignored") / F.col("postings"), 6))


#: Bits of a hash inside one bucket of packed postings, and of those that are looked at together; postings of a pack.
LOW, PART, PACK = 16, 12, 1 << 22
_SUMS = ["lines", "bytes", "postings", "saturated", "ignored"]


def text_line_stats(documents: DataFrame, config: EngineConfig, full: int = 255) -> DataFrame:
    """``line_stats`` of documents of which there is no index, with the same rows.

    A task packs the postings of some documents by buckets of hashes, as steps between
    hashes and places in a list of the documents; the packs are all that is shuffled.
    """
    if not LOW <= config.hash_width <= LOW + 8 or config.shard_size < 1 << LOW:
        return line_stats(build_index(documents, config), config, full)
    window, width = config.window, config.hash_width

    def pack(docs, made):
        hashes = np.concatenate(made)
        both = hashes << 32 | np.repeat(np.arange(len(made)), [len(m) for m in made])
        both.sort()
        hashes, doc = both >> 32, (both & 0xFFFFFFFF).astype(np.uint32)
        used, begin = np.unique(hashes >> LOW, return_index=True)
        packs, ends = [], [*begin[1:].tolist(), len(both)]
        for b, e in zip(begin.tolist(), ends):
            seen, own = np.unique(doc[b:e], return_inverse=True)
            low = np.diff(hashes[b:e] & ((1 << LOW) - 1), prepend=0).astype(np.uint16)
            table = pa.table({"low": [low.tobytes()], "doc": [own.astype(np.uint16 if len(seen) <= 1 << 16 else np.uint32).tobytes()], "wide": [len(seen) > 1 << 16], "keys": [docs[:, seen].tobytes()]})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            packs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(packs, pa.binary())], names=["bucket", "pack"])

    def packs(batches):
        keys, made, n = [], [], 0
        for batch in batches:
            for doctype, docid, text in zip(*(batch.column(i) for i in range(3))):
                hashes = np.unique(window_hashes(text.as_py(), window, width))
                if len(hashes):
                    keys.append((doctype.as_py(), docid.as_py()))
                    made.append(hashes)
                    n += len(hashes)
                if n >= PACK:
                    yield pack(np.array(keys, np.int64).T, made)
                    keys, made, n = [], [], 0
        if made:
            yield pack(np.array(keys, np.int64).T, made)

    def sums(group):
        parts = [pa.ipc.open_stream(x.as_py()).read_all().to_pylist()[0] for x in group["pack"]]
        docs = [np.frombuffer(x["keys"], np.int64).reshape(2, -1) for x in parts]
        known, rank = np.unique(np.concatenate(docs, axis=1), axis=1, return_inverse=True)
        rank, at = rank.reshape(-1), np.cumsum([0, *(d.shape[1] for d in docs)])
        low = [np.cumsum(np.frombuffer(x["low"], np.uint16).astype(np.int64)) for x in parts]
        doc = [np.frombuffer(x["doc"], np.uint32 if x["wide"] else np.uint16) for x in parts]
        total = np.zeros(len(_SUMS), np.int64)
        for first in range(0, 1 << LOW, 1 << PART):
            both = []
            for i, l in enumerate(low):
                b, e = np.searchsorted(l, (first, first + (1 << PART)))
                both.append(l[b:e] << 40 | rank[at[i] + doc[i][b:e].astype(np.int64)])
            both = np.concatenate(both)
            if not len(both):
                continue
            both.sort()
            hashes, (doctype, docid) = both >> 40, known[:, both & ((1 << 40) - 1)]
            line = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            kind = line.copy()
            kind[1:] |= doctype[1:] != doctype[:-1]
            delta = docid.copy()
            delta[1:] -= np.where(kind[1:], 0, docid[:-1])
            begin = np.flatnonzero(kind)
            size = np.add.reduceat(_varint_lengths(delta), begin)
            own, begin = _varint_lengths(doctype[begin]) + _varint_lengths(size) + size, np.flatnonzero(line[begin])
            length, n = 1 + np.add.reduceat(own, begin), np.diff(np.append(np.flatnonzero(line), len(both)))
            over = length >= full
            total += [len(n), length.sum(), n.sum(), over.sum(), n[over].sum()]
        shards = group["bucket"][0].as_py() // (config.shard_size >> LOW)
        return pa.table({"shard": pa.array([shards], pa.int64())} | {c: pa.array([int(v)], pa.int64()) for c, v in zip(_SUMS, total)})

    texts = documents.select(*KEY, normalise(F.col("text")).alias("text"))
    made = texts.mapInArrow(packs, "bucket long, pack binary").groupBy("bucket").applyInArrow(sums, ", ".join(f"{c} long" for c in ("shard", *_SUMS)))
    return _with_percent(made.groupBy("shard").agg(*(F.sum(c).alias(c) for c in _SUMS)))


def _varint_lengths(values: np.ndarray) -> np.ndarray:
    return 1 + sum((values >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))


def lowest_postings(postings: DataFrame, start: int, limit: int) -> DataFrame:
    """Each task's postings of its ``limit`` lowest different hashes from ``start`` on, read once."""

    def run(batches):
        held = np.empty((3, 0), np.int64)
        for batch in batches:
            held = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1)
            lowest = np.unique(held[0])[:limit]
            held = held[:, held[0] <= lowest[-1]] if len(lowest) else held[:, :0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["hash", *KEY])

    return postings.where(F.col("hash") >= start).select("hash", *KEY).mapInArrow(run, "hash long, doctype long, docid long")


def lowest_of_texts(documents: DataFrame, config: EngineConfig, start: int, limit: int) -> DataFrame:
    """``lowest_postings`` of documents of which there is no index: other postings are never made."""
    window, width = config.window, config.hash_width

    def run(batches):
        held, top = np.empty((3, 0), np.int64), None
        for batch in batches:
            parts = [held]
            for doctype, docid, text in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = window_hashes(text, window, width)
                own = np.unique(hashes[(hashes >= start) & (hashes <= top)] if top is not None else hashes[hashes >= start])
                if len(own):
                    parts.append(np.stack((own, np.full(len(own), doctype), np.full(len(own), docid))))
            held = np.concatenate(parts, axis=1)
            lowest = np.unique(held[0])[:limit]
            held = held[:, held[0] <= lowest[-1]] if len(lowest) else held[:, :0]
            top = lowest[-1] if 0 < len(lowest) == limit else None
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["hash", *KEY])

    def small(batches):
        yield from run(batch.slice(at, 64) for batch in batches for at in range(0, batch.num_rows, 64))

    return documents.select(*KEY, normalise(F.col("text")).alias("text")).mapInArrow(small, "hash long, doctype long, docid long")


def list_index(postings: DataFrame, start: int = 0, limit: int = 100) -> DataFrame:
    """Lines of the ``limit`` lowest hashes from ``start`` on; lines of other hashes are never built."""
    return _lowest_lines(lowest_postings(postings, start, limit), limit)


def list_texts(documents: DataFrame, config: EngineConfig, start: int = 0, limit: int = 100) -> DataFrame:
    """``list_index`` of documents of which there is no index, with the same rows."""
    return _lowest_lines(lowest_of_texts(documents, config, start, limit), limit)


def _lowest_lines(lowest: DataFrame, limit: int) -> DataFrame:
    own = materialise(lowest, "lowest-postings")
    chosen = F.broadcast(own.select("hash").distinct().orderBy("hash").limit(limit))
    return posting_lines(own.join(chosen, "hash", "left_semi")).orderBy("hash")


#: Hashes of one bitmap, and the widest hash that a task keeps a flag of one byte for (32 MB).
BITMAP = 1 << 15
BITMAP_WIDTH = 25


def index_stats(documents: DataFrame, config: EngineConfig) -> DataFrame:
    """By shard: windows seen, postings kept, repeats in a document, different hashes.

    A document's windows are counted where they are made. Up to ``BITMAP_WIDTH``
    bits a task also marks its hashes in bitmaps, which are all that is shuffled;
    wider hashes are counted by one row for each document and hash.
    """
    window, width = config.window, config.hash_width
    texts = documents.select(*KEY, normalise(F.col("text")).alias("text"))
    if width > BITMAP_WIDTH or config.shard_size % BITMAP:
        counted = exploded(texts, KEY, "text", lambda t: np.unique(window_hashes(t, window, width), return_counts=True), [("hash", "long"), ("n", "long")])
        by_hash = counted.groupBy("hash").agg(F.sum("n").alias("windows"), F.count(F.lit(1)).alias("postings"))
        found = by_hash.select(shard(config).alias("shard"), "windows", "postings", F.lit(1).cast("long").alias("hashes"))
    else:
        marked = _bitmaps(texts.select("text"), config).groupBy("shard", "bucket").agg(F.sum("windows").alias("windows"), F.sum("postings").alias("postings"), F.bitmap_or_agg("bits").alias("bits"))
        found = marked.select("shard", "windows", "postings", F.bitmap_count("bits").alias("hashes"))
    totals = found.groupBy("shard").agg(*(F.sum(c).alias(c) for c in ("windows", "postings", "hashes"))).where(F.col("windows") > 0)
    return totals.select("shard", "windows", "postings", (F.col("windows") - F.col("postings")).alias("repeats"), "hashes")


def _bitmaps(texts: DataFrame, config: EngineConfig) -> DataFrame:
    """For each task its counts by shard, and bitmaps of the hashes it met."""
    window, width, shards, size = config.window, config.hash_width, config.shards, config.shard_size
    names = ["shard", "bucket", "windows", "postings", "bits"]

    def run(batches):
        seen = np.zeros(1 << width, bool)
        windows, postings = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes = window_hashes(text, window, width)
                once = np.unique(hashes)
                windows += np.bincount(hashes // size, minlength=shards)
                postings += np.bincount(once // size, minlength=shards)
                seen[once] = True
        rows = seen.reshape(-1, BITMAP)
        used = np.flatnonzero(rows.any(axis=1))
        bits = [np.packbits(rows[b], bitorder="little").tobytes() for b in used]
        bucket = np.concatenate((np.full(shards, -1), used))
        own = np.concatenate((np.arange(shards), used * BITMAP // size))
        zeros = np.zeros(len(used), np.int64)
        columns = [pa.array(own), pa.array(bucket), pa.array(np.concatenate((windows, zeros))), pa.array(np.concatenate((postings, zeros))), pa.array([None] * shards + bits, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, "shard long, bucket long, windows long, postings long, bits binary")
