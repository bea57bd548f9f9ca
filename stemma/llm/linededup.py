"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.cuckoo import CuckooFilter, filled
from stemma.llm.texts import map_arrow
from stemma.shared import materialise, spread

#: Shortest key in code points that counts, and in how many documents it must be found.
SHORTEST = 10
DOCUMENTS = 2
#: Keys of one filter shard, about.
SHARD_KEYS = 400_000
#: References that are looked up in one shard's filters at once, about.
PART_REFERENCES = 1_000_000
#: Tables of references that an index keeps side by side before they are written as one.
SEGMENTS = 16


def line_key(line: bytes) -> bytes | None:
    """Digest of a line stripped of white space with A-Z lower-cased; None if it is too short."""
    key = line.strip().lower()
    if len(key) < SHORTEST or (len(key) < 4 * SHORTEST and len(key.decode("utf-8", "replace")) < SHORTEST):
        return None
    return xxhash.xxh3_128_digest(key)


def references(docs: DataFrame) -> DataFrame:
    """One row (doc_id, hi, lo) for each document and key in it, from whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, sizes, digests = batch.column(0), [], []
            for text in batch.column(1):
                keys = set(map(line_key, (text.as_py() or b"").split(b"\n")))
                keys.discard(None)
                sizes.append(len(keys))
                digests.extend(keys)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            owner = np.repeat(ids.to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], schema=schema)

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return map_arrow(texts, run, "doc_id long, hi long, lo long")


def _by_shard(rows: DataFrame, filters: DataFrame, function, schema: str, keys: tuple[str, ...] = ("shard",)) -> DataFrame:
    """Apply ``function(shard, rows, filters)`` to each shard, or bounded part of one.

    ``filters`` are two lists: those of the live keys and those of the shared ones.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = (left if left.num_rows else right).column("shard")[0].as_py()
        held = ([], [])
        for shared, blob in zip(right.column("shared").to_pylist(), right.column("filter")):
            held[shared].append(CuckooFilter.from_bytes(blob.as_py()))
        return function(shard, left, held)

    return rows.groupBy(*keys).cogroup(filters.groupBy(*keys)).applyInArrow(run, schema)


def _seen(hi: np.ndarray, lo: np.ndarray, filters: list[CuckooFilter]) -> np.ndarray:
    seen = np.zeros(len(hi), bool)
    for f in filters:
        seen |= f.has(hi, lo)
    return seen


def _filter_rows(shard: int, filters: tuple[list[CuckooFilter], list[CuckooFilter]]) -> pa.Table:
    both = [(shared, f.to_bytes()) for shared in (False, True) for f in filters[shared]]
    return pa.table({"shard": pa.array([shard] * len(both), pa.int32()), "shared": pa.array([x for x, _ in both], pa.bool_()), "filter": pa.array([x for _, x in both], pa.binary())})


FILTERS = "shard int, shared boolean, filter binary"


@dataclass
class LineIndex:
    """Which lines are in which documents, as immutable tables.

    ``refs`` (doc_id, hi, lo) is the exact table of references; ``counts`` (hi, lo,
    documents, first_doc) counts them for keys of two or more documents, a key
    outside it having one. ``filters`` (shard, shared, filter) holds for each shard
    cuckoo filters with one entry for every live key, and others with one for every
    key of ``counts``. A key that no live filter knows is new without a look at the
    tables; only references that a shared filter knows are looked up in ``counts``.
    Each change returns a new index and leaves the old one.
    """

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    segments: int = 1

    @staticmethod
    def build(docs: DataFrame) -> LineIndex:
        """Index a first batch of documents."""
        return LineIndex._of(materialise(references(docs).distinct() if _repeats(docs) else references(docs), "line-refs"))

    @staticmethod
    def _of(refs: DataFrame) -> LineIndex:
        # A multiple of the shuffle's partitions: every task then holds whole shards.
        parts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = parts * max(1, -(-refs.count() // (parts * SHARD_KEYS)))
        counted = refs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))
        made = materialise(_filtered(counted, shards), "line-counts")
        counts = made.where(F.col("filter").isNull()).select("hi", "lo", "documents", "first_doc")
        return LineIndex(refs, counts, made.where(F.col("filter").isNotNull()).select("shard", "shared", "filter"), shards)

    def _shard(self):
        return F.pmod(F.hash("hi", "lo"), F.lit(self.shards)).alias("shard")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents; ids that the index holds already are left as they are.

        An index whose references outgrow its shards twice over is built anew with
        more of them, so a shard stays bounded.
        """
        new = references(docs.join(self.refs.select("doc_id").distinct(), "doc_id", "left_anti")).distinct()
        new = materialise(new, "new-refs")
        refs, segments = self.refs.unionByName(new), self.segments + 1
        if segments > SEGMENTS:
            refs, segments = materialise(refs, "line-refs"), 1
        if refs.count() > 2 * SHARD_KEYS * self.shards:
            return LineIndex._of(materialise(refs, "line-refs"))

        def probe(shard, keys, filters):
            hi, lo = (keys.column(c).to_numpy() for c in ("hi", "lo"))
            return pa.table({"shard": pa.array([shard] * len(hi), pa.int32()), "hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64()), "seen": pa.array(_seen(hi, lo, filters[False]), pa.bool_())})

        keys = new.select(self._shard(), "hi", "lo").distinct()
        probed = materialise(_by_shard(keys, self.filters, probe, "shard int, hi long, lo long, seen boolean"), "probed")
        # Only keys that a filter knows need the old references; some are seen through the marks of other keys.
        known = materialise(self.refs.join(probed.where("seen").select("hi", "lo"), ["hi", "lo"], "left_semi"), "known-refs")
        touched = materialise(_counted(known.select("doc_id", "hi", "lo").unionByName(new)), "touched-counts")
        # So that each key has one entry of its own, every key without old references is added, seen or not.
        fresh = probed.join(known.select("hi", "lo").distinct(), ["hi", "lo"], "left_anti").select("shard", "hi", "lo")
        risen = touched.join(self.counts.select("hi", "lo"), ["hi", "lo"], "left_anti").select(self._shard(), "hi", "lo")
        more = fresh.withColumn("shared", F.lit(False)).unionByName(risen.withColumn("shared", F.lit(True)))

        def extend(shard, keys, filters):
            made = ([], [])
            for kind in (False, True):
                own = keys.filter(pa.array(keys.column("shared").to_numpy() == kind))
                made[kind].extend(filled(own.column("hi").to_numpy(), own.column("lo").to_numpy(), filters[kind], 2 * SHARD_KEYS if filters[kind] else own.num_rows))
            return _filter_rows(shard, made)

        filters = materialise(_by_shard(more, self.filters, extend, FILTERS), "line-filters")
        counts = self.counts.join(new.select("hi", "lo").distinct(), ["hi", "lo"], "left_anti").unionByName(touched)
        return LineIndex(refs, materialise(counts, "line-counts"), filters, self.shards, segments)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents (column doc_id) out again; lines they held alone are forgotten."""
        ids = doc_ids.select("doc_id").distinct()
        gone = materialise(self.refs.join(ids, "doc_id", "left_semi"), "gone-refs")
        refs = materialise(self.refs.join(ids, "doc_id", "left_anti"), "line-refs")
        touched = gone.select("hi", "lo").distinct()
        left = materialise(refs.join(touched, ["hi", "lo"], "left_semi"), "left-refs")
        recounted = materialise(_counted(left), "touched-counts")
        counts = materialise(self.counts.join(touched, ["hi", "lo"], "left_anti").unionByName(recounted), "line-counts")

        def forget(shard, keys, filters):
            for kind in (False, True):
                own = keys.filter(pa.array(keys.column("shared").to_numpy() == kind))
                for f in filters[kind]:
                    f.remove(own.column("hi").to_numpy(), own.column("lo").to_numpy())
            return _filter_rows(shard, filters)

        def rebuild(shard, keys, filters):
            made = ([], [])
            for kind in (False, True):
                own = keys.filter(pa.array(keys.column("shared").to_numpy() == kind))
                made[kind].extend(filled(own.column("hi").to_numpy(), own.column("lo").to_numpy(), [], 2 * own.num_rows))
            return _filter_rows(shard, made)

        # Within one filter equal marks share both buckets, so any entry will do. Of several filters a mark
        # does not tell which holds the key: those of such shards are made anew from the exact tables.
        several = self.filters.groupBy("shard", "shared").agg(F.count(F.lit(1)).alias("filters")).where("filters > 1").select("shard").distinct()
        several = materialise(several, "many-filters")
        dead = touched.join(left.select("hi", "lo").distinct(), ["hi", "lo"], "left_anti").select(self._shard(), "hi", "lo", F.lit(False).alias("shared"))
        fallen = self.counts.join(touched, ["hi", "lo"], "left_semi").join(recounted.select("hi", "lo"), ["hi", "lo"], "left_anti").select(self._shard(), "hi", "lo", F.lit(True).alias("shared"))
        made = _by_shard(dead.unionByName(fallen).join(several, "shard", "left_anti"), self.filters.join(several, "shard", "left_anti"), forget, FILTERS)
        if not several.isEmpty():
            live = refs.select(self._shard(), "hi", "lo").distinct().withColumn("shared", F.lit(False))
            live = live.unionByName(counts.select(self._shard(), "hi", "lo", F.lit(True).alias("shared"))).join(several, "shard", "left_semi")
            made = made.unionByName(_by_shard(live, self.filters.join(several, "shard", "left_semi"), rebuild, FILTERS))
        return LineIndex(refs, counts, materialise(made, "line-filters"), self.shards)

    def drops(self) -> DataFrame:
        """Rows (doc_id, hi, lo): the keys whose lines each document loses.

        Every shard's filter of shared keys is asked for the references of that
        shard; only those that it knows meet the exact counts. A shard of many
        references, as one with a line that a third of all documents hold, is asked
        in parts, each with its own copy of the filter.
        """
        placed = self.refs.withColumn("shard", self._shard())
        sizes = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART_REFERENCES).cast("int").alias("parts"))
        sizes = materialise(sizes, "shard-parts")
        part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
        placed = placed.join(sizes, "shard").select("shard", part.alias("part"), "doc_id", "hi", "lo")
        sent = self.filters.where("shared").join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def known(shard, refs, filters):
            hi, lo = (refs.column(c).to_numpy() for c in ("hi", "lo"))
            return refs.select(["doc_id", "hi", "lo"]).filter(pa.array(_seen(hi, lo, filters[True]), pa.bool_()))

        maybe = _by_shard(placed, sent, known, "doc_id long, hi long, lo long", ("shard", "part"))
        return maybe.join(self.counts, ["hi", "lo"]).where(F.col("doc_id") != F.col("first_doc")).select("doc_id", "hi", "lo")


def _repeats(docs: DataFrame) -> bool:
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    return not ids.where("rows > 1").isEmpty()


def _counted(refs: DataFrame) -> DataFrame:
    counted = refs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))
    return counted.where(F.col("documents") >= DOCUMENTS)


def _filtered(counted: DataFrame, shards: int) -> DataFrame:
    """The counts of shared keys, and for every shard a filter of all its keys and one of the shared ones."""
    names = ["shard", "hi", "lo", "documents", "first_doc", "shared", "filter"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches):
        held: list[list[np.ndarray]] = []
        own = None

        def filters():
            shard, hi, lo, documents = (np.concatenate(c) for c in zip(*held))
            shared = documents >= DOCUMENTS
            table = _filter_rows(own, (filled(hi, lo, []), filled(hi[shared], lo[shared], [])))
            for batch in table.to_batches():
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.nulls(batch.num_rows, t) for t in types[1:5]), batch.column(1), batch.column(2)], schema=schema)

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            keep = columns[3] >= DOCUMENTS
            yield pa.RecordBatch.from_arrays([*(pa.array(c[keep], t) for c, t in zip(columns, types)), *(pa.nulls(int(keep.sum()), t) for t in types[5:])], schema=schema)
            cuts = np.flatnonzero(np.diff(columns[0])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a < b:
                    if own != columns[0][a]:
                        if held:
                            yield from filters()
                        held, own = [], int(columns[0][a])
                    held.append([c[a:b] for c in columns[:4]])
        if held:
            yield from filters()

    shard = F.pmod(F.hash("hi", "lo"), F.lit(shards)).alias("shard")
    rows = counted.select(shard, "hi", "lo", "documents", "first_doc").sortWithinPartitions("shard")
    return map_arrow(rows, run, "shard int, hi long, lo long, documents long, first_doc long, shared boolean, filter binary", rows=1 << 16)


def _kept(text: bytes, drop: set[bytes]) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    if not drop:
        return text, len(lines), 0
    stay = [line for line in lines if line_key(line) not in drop]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def _with_drops(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """All columns of ``docs``, then one array column of the keys that each row loses."""
    lost = drops.groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_list(F.struct("hi", "lo")).alias("lost"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = whole.join(lost, F.col("row.doc_id") == F.col("lost_id"), "left")
    free = "lost" + "_" * max(map(len, docs.columns))  # longer than any name of theirs
    return joined.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("lost").alias(free))


def _drop_sets(column: pa.Array) -> list[set[bytes]]:
    """The keys of each row as digests."""
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else []
    if not len(flat):
        return [set() for _ in range(len(column))]
    halves = np.stack((flat.field("hi").to_numpy(), flat.field("lo").to_numpy()), axis=1).astype("<i8").tobytes()
    out, at = [], 0
    valid = column.is_valid().to_pylist()
    for n, ok in zip(sizes.tolist(), valid):
        n = n if ok else 0
        out.append({halves[16 * i : 16 * i + 16] for i in range(at, at + n)})
        at += n
    return out


def line_report(docs: DataFrame, index: LineIndex) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_sha256) for all documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            made = [_kept(t.as_py() or b"", d) for t, d in zip(batch.column(1), _drop_sets(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()),
                pa.array([hashlib.sha256(m[0]).hexdigest() for m in made], pa.string()),
            ], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return map_arrow(_with_drops(texts, index.drops()), run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """The documents with their repeated lines dropped; n_chars follows where it is a column.

    Of a key (see ``line_key``) found in at least two documents all lines go except
    in the smallest doc_id that holds it; repeats within one document stay. Null
    doc_id: the row neither counts nor loses lines. Rows that share an id are one
    document. Null text stays null. Empty table: empty result. All other columns
    pass unchanged.
    """
    index = index or LineIndex.build(docs)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:-1])
            drops = _drop_sets(batch.column(len(names)))
            texts = columns[at].cast(pa.binary())
            kept = [None if t is None else _kept(t, d)[0].decode("utf-8", "replace") for t, d in zip(texts.to_pylist(), drops)]
            columns[at] = pa.array(kept, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if k is None else len(k) for k in kept], batch.column(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(_with_drops(docs, index.drops()), run, docs.schema)


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return line_report(docs, LineIndex.build(docs))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first_doc AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
