"""Near-dedup by the Jaccard similarity of word shingles: SimHash links, verified, and an exact search for the rest.

Fingerprints cannot see all that is similar: at a similarity of 0.8 two 64-bit
SimHashes differ in about ten bits. So their links come first, and what they leave
apart is found by shared rare shingles; every link is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm import simhash
from stemma.llm.components import connected_components
from stemma.llm.texts import map_arrow
from stemma.shared import drop, materialise, scratch

SHINGLE = 5
SEED = 42
#: Sets are near-duplicates from this Jaccard similarity on: a fraction of whole numbers, as floats would round.
PART, WHOLE = 4, 5
#: Rows of one shingle that a task compares at once; larger ones are split.
HOT_ROWS = 4096
#: Shingles are counted in one set of so many.
SOME = 16
#: Shingles in so many of the counted sets are common; at most so many of them, the most frequent, are known as such.
COMMON_SETS, COMMON = 4, 1 << 18
#: Keys that a task gathers before it compares them, and pairs before it hands them on.
GATHERED = 1 << 18


def shingle_set(text: bytes | None) -> np.ndarray:
    """Different hashes of all runs of ``SHINGLE`` words, in rising order; of all words if there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    k = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends + 1))[: len(words) - k + 1].tolist()
    stops = np.concatenate((ends, [len(joined)]))[k - 1 :].tolist()
    xxh64 = xxhash.xxh64_intdigest
    return np.unique(np.array([xxh64(joined[i:j], SEED) for i, j in zip(starts, stops)], np.uint64))


def prefix_length(n):
    """How many of the lowest of n shingles any set that is near enough must share one of."""
    return n - (PART * n + WHOLE - 1) // WHOLE + (n > 0)


def near_enough(common, a, b):
    """Whether sets of a and b shingles with so many in common reach the similarity."""
    return common * (PART + WHOLE) >= PART * (a + b)


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def parities(shingles: np.ndarray) -> bytes:
    """For each of about as many places as shingles, a power of two, whether an odd number of them falls there."""
    places = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """In how many shingles sets of these parities differ at least: each one changes one parity."""
    x, y = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(x) != len(y):
        x, y = (v if len(v) == min(len(x), len(y)) else v[: len(v) // 2] ^ v[len(v) // 2 :] for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(docs: DataFrame, some: int = SOME, least: int = COMMON_SETS, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, in rising order, and the rank of each by its frequency, rarest first.

    Counted in one of ``some`` different texts, in executors; at most ``most`` come to
    the driver. They set an order of shingles, so what the count misses costs time only.
    """
    schema = pa.schema([("key", pa.int64())])

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py()).view(np.int64))], schema=schema)

    texts = docs.select(F.col("text").cast("binary").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(some)) == 0).distinct()
    counted = map_arrow(texts, run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") >= least)
    counted = materialise(counted, "common-shingles")
    held, floor = 0, None
    for row in counted.groupBy("sets").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("sets")).collect():
        held += row["n"]
        if held > most:
            break
        floor = row["sets"]
    if floor is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = counted.where(F.col("sets") >= floor).toArrow()
    keys, sets = found.column("key").to_numpy().view(np.uint64), found.column("sets").to_numpy()
    order = np.argsort(keys)
    keys, sets = keys[order], sets[order]
    ranks = np.empty(len(keys), np.int64)
    ranks[np.lexsort((keys, sets))] = np.arange(len(keys))
    return keys, ranks


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, as many as ``prefix_length`` says: the common ones come last, rarest first, the others by hash."""
    keys, ranks = common
    n = prefix_length(len(shingles))
    if not len(keys) or not len(shingles):
        return shingles[:n]
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    known = keys[at] == shingles
    rare = shingles[~known][:n]
    if len(rare) == n:
        return rare
    return np.concatenate((rare, shingles[known][np.argsort(ranks[at[known]])][: n - len(rare)]))


def _prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.int64))) -> DataFrame:
    """Rows (doc_id, node, fingerprint, size, prefix, parity): a digest of the set, its SimHash, size, first shingles and parities."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("fingerprint", pa.int64()), ("size", pa.int32()), ("prefix", pa.list_(pa.int64())), ("parity", pa.binary())])

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            low = [prefix(s, common).view(np.int64) for s in sets]
            prints = np.array([simhash.voted([s]) for s in sets], "<u8").view("<i8")
            columns = [batch.column(0), pa.array([_node(s) for s in sets], pa.int64()), pa.array(prints), pa.array([len(s) for s in sets], pa.int32()), pa.array(low, pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, "doc_id long, node long, fingerprint long, size int, prefix array<long>, parity binary", rows=256)


def pairs_within(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, places: np.ndarray, roots: np.ndarray):
    """Pairs (a, b) of rows of equal keys whose sizes and places in the sets allow the similarity.

    Rows come in the order of keys, then sizes. Of the first shingle that two sets
    share, only what follows it in both can be in common too. Rows of one root,
    other than 0, are linked already.
    """
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    end = np.repeat(np.concatenate((starts[1:], [len(keys)])), np.diff(np.concatenate((starts, [len(keys)]))))
    rest = sizes - places
    alive, step = np.arange(len(keys)), 1
    while True:
        alive = alive[alive + step < end[alive]]
        alive = alive[sizes[alive] * WHOLE >= PART * sizes[alive + step]]
        if not len(alive):
            return
        other = alive + step
        fits = near_enough(np.minimum(rest[alive], rest[other]), sizes[alive], sizes[other]) & (nodes[alive] != nodes[other])
        fits &= (roots[alive] != roots[other]) | (roots[alive] == 0)
        a, b = nodes[alive[fits]], nodes[other[fits]]
        yield np.minimum(a, b), np.maximum(a, b)
        step += 1


def _candidates(keyed: DataFrame) -> DataFrame:
    """Different pairs (a, b) of rows (key, size, place, node, root) that share a key and may be similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held, rows = [], 0

        def found(columns):
            made, n = [], 0
            for pair in pairs_within(columns[0], columns[3], columns[1].astype(np.int64), columns[2].astype(np.int64), columns[4]):
                made.append(np.stack(pair))
                n += len(pair[0])
                if n >= GATHERED:
                    yield packed(made)
                    made, n = [], 0
            if n:
                yield packed(made)

        def packed(made):
            a, b = np.unique(np.concatenate(made, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows >= GATHERED:
                columns = [np.concatenate(c) for c in zip(*held)]
                whole = np.searchsorted(columns[0], columns[0][-1])
                yield from found([c[:whole] for c in columns]) if whole else ()
                held = [[c[whole:] for c in columns]]
                rows = 0
        if held:
            yield from found([np.concatenate(c) for c in zip(*held)])

    ordered = keyed.select("key", "size", "place", "node", "root").repartition("key").sortWithinPartitions("key", "size")
    return map_arrow(ordered, run, "a long, b long", rows=1 << 16).distinct()


def candidates(classes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All pairs (a, b) of sets (node, size, prefix, root) that may be similar, but those of one root (null: none).

    Two sets of Jaccard similarity s or more share one of the first n - ceil(s n) + 1
    shingles of each, whatever the order of shingles, if all sets keep to it; so no pair is left
    out. With common shingles last in that order, a passage that a part of all texts share makes
    no pairs of texts that differ in the rest. Shingles in more than about ``hot_rows`` prefixes
    are cut into pairs of tiles.
    """
    keyed = classes.select("node", "size", F.coalesce("root", F.lit(0).cast("long")).alias("root"), F.posexplode("prefix").alias("place", "key"))
    # An estimate from some of the sets will do: it sets the number of tiles, not what is compared.
    some = keyed.where(F.pmod(F.xxhash64("node"), F.lit(SOME)) == 0)
    hot = materialise(some.groupBy("key").agg((F.count(F.lit(1)) * SOME).alias("rows")).where(F.col("rows") > hot_rows), "hot-shingles")
    if hot.isEmpty():
        return _candidates(keyed)
    tiles = F.ceil(F.col("rows") / hot_rows).cast("int")
    tiled = keyed.join(hot, "key").withColumn("mine", F.pmod(F.xxhash64("node"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return _candidates(keyed.join(hot, "key", "left_anti")).unionByName(_candidates(tiled.withColumn("key", pair))).distinct()


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose parities allow the similarity; no similar pair is lost."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b, m, n, x, y = (c.to_pylist() for c in batch.columns)
            # Sets that differ in d shingles have (m + n - d) / 2 in common.
            keep = [near_enough((i + j - least_difference(v, w)) / 2, i, j) for i, j, v, w in zip(m, n, x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(classes.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("parity").alias("x")), "a")
    joined = joined.join(classes.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("parity").alias("y")), "b")
    return map_arrow(joined.select("a", "b", "m", "n", "x", "y"), run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                keep.append(near_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    return map_arrow(joined.select("a", "b", "left", "right"), run, "a long, b long", rows=64)


def _sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (node, shingles) with the whole sets at the ends of the ``pairs`` of ``classes``."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(classes.select("node", "first_id").join(ends, "node", "left_semi"), "wanted-sets")
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(wanted.select("first_id").distinct(), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("text")
    # Rows that share an id or have none may bring sets that nobody asked for.
    return map_arrow(texts, run, "node long, shingles binary", rows=64).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def simhash_pairs(classes: DataFrame, distance: int = simhash.DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (a, b) of sets (node, fingerprint) that hang together by SimHashes within ``distance`` bits.

    The links are those of the pivot distance tables between different fingerprints,
    and a star of the sets of one fingerprint; not all pairs.
    """
    prints = materialise(classes.groupBy("fingerprint").agg(F.min("node").alias("first_node")), "set-prints")
    near = simhash.near_links(prints.select("fingerprint"), distance, hot_rows)
    of = lambda end: prints.select(F.col("fingerprint").alias(end), F.col("first_node").alias(f"node_{end}"))
    between = near.join(of("a"), "a").join(of("b"), "b").select("node_a", "node_b")
    within = classes.select("node", "fingerprint").join(prints, "fingerprint").select(F.col("node").alias("node_a"), F.col("first_node").alias("node_b"))
    ends = between.unionByName(within).where("node_a <> node_b")
    return ends.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def components(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (doc_id, component_id) for all documents, linked by similarity.

    Texts are lower-cased (A-Z) and cut into words. Two texts link if the Jaccard
    similarity of their sets of five-word shingles is 0.8 or more; of fewer words,
    all together are one shingle. component_id is the smallest doc_id that can be
    reached. Equal sets are one node, so copies are never paired; a text without
    words has the empty set. Null ids name no component.
    """
    with scratch(docs.sparkSession) as keep:
        marked = materialise(_prefixes(docs, common_shingles(docs)), "prefixes")
        ids = materialise(marked.select("doc_id", "node"), "set-ids")
        classes = materialise(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fingerprint").alias("fingerprint"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")), "set-classes")
        drop(marked)
        # What the SimHash links join is never paired again, so a dense group of near copies costs one link for each set.
        seen = materialise(_possible(simhash_pairs(classes, hot_rows=hot_rows), classes), "simhash-pairs")
        links = materialise(_verified(seen, _sets(docs, classes, seen)), "simhash-links")
        roots = materialise(connected_components(links), "simhash-roots")
        # The smallest node of a component has no row of its own there.
        rooted = roots.select("node", F.col("component").alias("root")).unionByName(roots.select(F.col("component").alias("node"), F.col("component").alias("root")).distinct())
        rooted = classes.join(rooted, "node", "left")
        pairs = materialise(_possible(candidates(rooted, hot_rows), classes), "candidates")
        sets = materialise(_sets(docs, classes, pairs), "whole-sets")
        # Of the rest, the first look takes one star for each set; the second judges all pairs that are still apart.
        stars = _verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets)
        links = materialise(links.unionByName(stars), "star-links")
        near = materialise(connected_components(links), "star-roots")
        a = near.select(F.col("node").alias("a"), F.col("component").alias("root_a"))
        b = near.select(F.col("node").alias("b"), F.col("component").alias("root_b"))
        apart = pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        roots = materialise(connected_components(links.unionByName(_verified(apart, sets))), "set-roots")
        rooted = classes.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("root"))
        named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
        return keep(materialise(ids.join(named, "node").select("doc_id", "component_id"), "set-components"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without near-duplicates: of each component the smallest doc_id stays.

    All columns are kept. Rows that share an id, or have none, are one document and
    stay together; those without stay if some component of theirs has no id at all.
    """
    judged = components(docs, **options)
    stay = judged.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay_id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay_id"]), "left_semi")
