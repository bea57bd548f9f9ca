"""Every text of one side with every text of the other, in pairs of bounded blocks.

Texts are packed into compressed blocks, written once. A task takes one block of
either side: what it finds of a pair of texts is all there is of it, so no window
and no posting is shuffled, and memory is bounded by the blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.hashing import window_hashes
from stemma.plans.config import EngineConfig
from stemma.shared import materialise

#: Bytes of text of a block, and hits of a text that are looked at together.
BLOCK, HITS = 1 << 23, 1 << 21
#: The widest number by which windows are addressed without a search.
DIRECT = 24
#: Rows that a task holds before it gives them away.
ROWS = 1 << 17
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def packed(texts: DataFrame, keys: list[str], label: str, gather: bool = False, size: int = 0) -> DataFrame:
    """One row ``block`` for some ``size`` bytes (``BLOCK`` if 0) of rows (keys, normal); with ``gather`` rows of all partitions are put together."""
    schema, size = pa.schema([*((k, pa.int64()) for k in keys), ("normal", pa.string())]), size or BLOCK
    if gather:
        total = texts.agg(F.sum(F.length("normal"))).first()[0] or 0
        texts = texts.repartition(max(1, -(-total // size)))

    def block(rows):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(rows).cast(schema).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            begin = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(len(keys))), 0).to_pylist(), 1):
                held += n + 8
                if held >= size:
                    yield block([*rows, batch.slice(begin, i - begin)])
                    rows, held, begin = [], 0, i
            if begin < batch.num_rows:
                rows.append(batch.slice(begin))
        if rows:
            yield block(rows)

    return materialise(texts.select(*keys, "normal").mapInArrow(run, "block binary"), label, rows_per_file=1)


def crossed(left: DataFrame, right: DataFrame, begin: Callable, schema: str, label: str) -> DataFrame:
    """What ``begin(table of a left block)(table of a right block)`` yields (record batches), of all pairs of blocks."""

    def run(batches):
        known, step = None, None
        for batch in batches:
            for ours, theirs in zip(*(c.to_pylist() for c in batch.columns)):
                if ours != known:
                    step = None  # before the next takes memory
                    known, step = ours, begin(pa.ipc.open_stream(ours).read_all())
                yield from step(pa.ipc.open_stream(theirs).read_all())

    spark = left.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "1")
    try:
        cells = left.select(F.col("block").alias("ours")).hint("shuffle_replicate_nl").crossJoin(right.select(F.col("block").alias("theirs")))
        return materialise(cells.mapInArrow(run, schema), label)
    finally:
        spark.conf.set(_BATCH, before)


def gathered(parts, names: list[str]):
    """Record batches of ``ROWS`` rows or more from tuples of arrays of longs."""
    held, n = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= ROWS:
            yield _rows(held, names)
            held, n = [], 0
    if held:
        yield _rows(held, names)


def _rows(held, names):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*held)], names=names)


def expanded(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges of ``n`` numbers from each of ``low`` on, one after the other."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Places:
    """Windows of many texts, in order of a number of ``width`` bits each."""

    def __init__(self, numbers: list[np.ndarray], width: int):
        sizes = np.array([len(x) for x in numbers], np.int64)
        joined = np.concatenate(numbers) if len(numbers) else np.empty(0, np.int64)
        if width <= 32:
            both = joined.astype(np.uint64) << np.uint64(32) | np.arange(len(joined), dtype=np.uint64)
            both.sort()
            order, joined = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.int64)
        else:
            order = np.argsort(joined, kind="stable")
            joined = joined[order]
        self.order = order
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.pos = (order - (np.cumsum(sizes) - sizes)[self.text]).astype(np.int32)
        self.first, self.numbers = None, joined
        if width <= DIRECT:
            self.first = np.concatenate(([0], np.cumsum(np.bincount(joined, minlength=1 << width)))).astype(np.int64 if len(joined) >> 31 else np.int32)
            self.numbers = None

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each number's windows begin, and how many there are."""
        if self.first is not None:
            low = self.first[numbers].astype(np.int64)
            return low, self.first[numbers + 1] - low
        low = np.searchsorted(self.numbers, numbers, "left")
        return low, np.searchsorted(self.numbers, numbers, "right") - low


class Probes:
    """The queries of a block: which of them share many hashes with a text."""

    def __init__(self, texts: list[str], config: EngineConfig):
        self.config, self.bits = config, config.shards.bit_length() - 1
        self.places = Places([window_hashes(t, config.window, config.hash_width) for t in texts], config.hash_width)

    def strong(self, text: str, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Of each query and shard with enough hits in ``text``: query, shard, count, sum and sum of squares of the steps between hits.

        Queries that are marked in ``own`` are left out.
        """
        config, places = self.config, self.places
        held = np.unique(window_hashes(text, config.window, config.hash_width))
        low, n = places.find(held)
        some = n > 0
        held, low, n = held[some], low[some], n[some]
        shard = (held.view(np.uint64) >> np.uint64(config.hash_width - self.bits)).astype(np.int64) if self.bits else np.zeros(len(held), np.int64)
        stretch = np.cumsum(n) // HITS
        cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(n)]

        def hits():
            for a, b in zip(cuts, cuts[1:]):
                at = expanded(low[a:b], n[a:b])
                yield at, places.text[at].astype(np.int64) * config.shards + np.repeat(shard[a:b], n[a:b])

        parts = list(hits()) if len(cuts) == 2 else None
        counts = np.zeros(1, np.int64)
        for _, key in parts or hits():
            more = np.bincount(key)
            if len(more) > len(counts):
                counts, more = more, counts
            counts[: len(more)] += more
        enough = counts >= config.min_hits
        if own is not None:
            for q in own:
                enough[q * config.shards : (q + 1) * config.shards] = False
        if not enough.any():
            return (np.empty(0, np.int64),) * 5
        joined = np.concatenate([key[k] << 32 | places.pos[at[k]] for at, key in parts or hits() for k in [enough[key]]])
        joined.sort()
        key, pos = joined >> 32, joined & 0xFFFFFFFF
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        steps = np.concatenate(([0], np.diff(pos)))
        steps[begin] = 0
        key, count = key[begin], np.diff(np.append(begin, len(pos)))
        return key // config.shards, key % config.shards, count, np.add.reduceat(steps, begin), np.add.reduceat(steps * steps, begin)
