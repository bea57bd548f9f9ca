"""SimHash near-dedup over pivot distance tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.components import connected_components
from stemma.llm.texts import map_arrow
from stemma.shared import materialise, spread

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Rows of one block value that a task compares at once; larger ones are split.
HOT_ROWS = 4096
#: Reference fingerprints: rows of the 64-bit Walsh code, any two 32 bits apart.
PIVOTS = [sum(1 << i for i in range(64) if bin(i & k).count("1") % 2) for k in (1, 2, 4, 8, 16, 32, 63, 21, 42, 7, 56, 27, 45, 51, 14, 35)]

BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def voted(batches) -> int:
    """The 64-bit SimHash, as an unsigned number, of hashes in arrays: each bit as most of them have it, else 0."""
    counts, n, lane = np.zeros((8, 256), np.int64), 0, np.arange(8) * 256
    for hashes in batches:
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + lane).ravel(), minlength=2048).reshape(8, 256)
        n += len(hashes)
    ones = (counts @ BITS).ravel() * 2 > n
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as an unsigned number; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], ends + 1))
    stops = np.concatenate((ends, [len(joined)]))
    k = min(shingle, len(words))
    starts, stops = starts[: len(words) - k + 1], stops[k - 1 :]
    xxh64 = xxhash.xxh64_intdigest

    def hashed():
        for at in range(0, len(starts), 1 << 18):
            spans = zip(starts[at : at + (1 << 18)].tolist(), stops[at : at + (1 << 18)].tolist())
            yield np.array([xxh64(joined[i:j], SEED) for i, j in spans], "<u8")

    return voted(hashed())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fingerprint as a signed long), from whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, "doc_id long, fingerprint long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]


def pivot_keys(prints: DataFrame, blocks: int, distance: int = DISTANCE) -> DataFrame:
    """Rows (fingerprint, key), so that any two fingerprints within ``distance`` share a key.

    The pivot table holds, for each of ``blocks`` parts of the 64 bits, the Hamming
    distances of that part to all references, four bits each. Two fingerprints that
    differ in ``distance`` bits differ in at most as many parts, so in at least
    ``blocks - distance`` parts their greatest coordinate difference is 0: each
    choice of that many parts makes one key.
    """
    parts = {}
    for n, mask in enumerate(_blocks(blocks)):
        coordinates = [F.shiftleft(F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask)))).cast("long"), 4 * k) for k, p in enumerate(PIVOTS)]
        parts[f"part{n}"] = reduce(lambda x, y: x.bitwiseOR(y), coordinates)
    table = prints.select("fingerprint", *(v.alias(k) for k, v in parts.items()))
    chosen = combinations(parts, blocks - distance)
    return table.select("fingerprint", F.explode(F.array(*(F.xxhash64(F.lit(n), *c) for n, c in enumerate(chosen)))).alias("key"))


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def links_within(keys: np.ndarray, prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of equal keys, as one star per set that hangs together.

    All pairs of a key are judged: those whose coordinates (distances to the
    references) differ by more than ``distance`` anywhere are discarded - by the
    first coordinate through sorting, by the others one after the other - and the
    survivors are verified. Returned are indexes (member, centre), so a dense set
    of k rows gives k - 1 links, not all its pairs.
    """
    pivots = np.array(PIVOTS, np.uint64)
    first = np.bitwise_count(prints ^ pivots[0]).astype(np.int16)
    order = np.lexsort((first, keys))
    keys, prints, first = keys[order], prints[order], first[order]
    table = [np.bitwise_count(prints ^ p).astype(np.int16) for p in pivots[1:]]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    end = np.repeat(np.concatenate((starts[1:], [len(keys)])), np.diff(np.concatenate((starts, [len(keys)]))))
    parent = np.arange(len(keys))
    alive, step = parent, 1
    while True:
        alive = alive[alive + step < end[alive]]
        alive = alive[first[alive + step] - first[alive] <= distance]
        if not len(alive):
            break
        left = alive
        for coordinate in table:
            left = left[np.abs(coordinate[left + step] - coordinate[left]) <= distance]
        left = left[np.bitwise_count(prints[left] ^ prints[left + step]) <= distance]
        left = left[parent[left] != parent[left + step]]
        for i in left.tolist():
            x, y = i, i + step
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)
        if len(left):
            parent = _find(parent)
        step += 1
    member = np.flatnonzero(parent != np.arange(len(parent)))
    return order[member], order[parent[member]]


def _linked(keyed: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) within every key of rows (key, fingerprint), key by key in a stream."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(keys, prints):
            a, b = links_within(keys, prints.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], schema=schema)

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            prints = np.concatenate((prints, batch.column(1).to_numpy()))
            whole = np.searchsorted(keys, keys[-1])
            if whole:
                yield found(keys[:whole], prints[:whole])
                keys, prints = keys[whole:], prints[whole:]
        if len(keys):
            yield found(keys, prints)

    return map_arrow(keyed.select("key", "fingerprint").repartition("key").sortWithinPartitions("key"), run, "a long, b long")


def near_links(prints: DataFrame, distance: int = DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links between distinct fingerprints whose sets are those within ``distance`` bits.

    The number of blocks follows the number of fingerprints, so that a key holds few
    of them. Keys with more than ``hot_rows`` are left to keys over more blocks, and
    what is still as large to tiles: each pair of tiles is one bounded key. So no
    task meets more than twice ``hot_rows`` of a key, and no pair is left out.
    """
    n = prints.count()
    blocks = next((m for m in range(distance + 1, distance + 4) if n / 2 ** (64 * (m - distance) / m) <= 64), distance + 4)
    found: DataFrame | None = None
    for blocks in range(blocks, distance + 5):
        keyed = pivot_keys(prints, blocks, distance)
        hot = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows), "hot-keys")
        if hot.isEmpty():
            links = _linked(keyed, distance)
            return links if found is None else found.unionByName(links)
        links = materialise(_linked(keyed.join(hot, "key", "left_anti"), distance), "cold-links")
        found = links if found is None else found.unionByName(links)
        crowded = keyed.join(hot, "key")
        prints = materialise(crowded.select("fingerprint").distinct(), "crowded")
    tiles = F.ceil(F.col("rows") / hot_rows).cast("int")
    tiled = crowded.withColumn("mine", F.pmod(F.xxhash64("fingerprint"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return found.unionByName(_linked(tiled.select(pair.alias("key"), "fingerprint"), distance))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (doc_id, fingerprint in hex, component_id) for all documents.

    Texts are lower-cased (A-Z) and cut into words; shingles of ``shingle`` words,
    repeats included, are hashed and vote for the bits. Fingerprints link at
    ``distance`` or fewer differing bits; component_id is the smallest doc_id that
    can be reached. Equal fingerprints are one node, so copies are never paired.

    Null, empty and blank texts have fingerprint 0 and link like any other. Null
    doc_id: the row takes part, but names no component (which is null if nobody
    else in it has an id). Repeated rows each get a row. Empty table: empty result.
    Other columns are ignored, whatever their names.
    """
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    classes = materialise(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = materialise(connected_components(near_links(classes.select("fingerprint"), distance, hot_rows)), "roots")
    rooted = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Only classes that have links need the second look; the rest keep their own first id.
    named = rooted.join(named, "root").select("fingerprint", "component_id")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return marked.join(named, "fingerprint").select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without near-duplicates: of each component the smallest doc_id stays.

    All columns are kept. Rows that share an id are one document and stay together.
    Documents without an id stay only if their whole component has none.
    """
    judged = near_duplicates(docs, **options)
    stay = judged.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay_id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay_id"]), "left_semi")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
