import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest_llm import EDGE_IDS, EDGES, documents, with_clashes
from stemma.llm import simhash as S
from stemma.llm.components import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    smallest = {}
    for k, i in enumerate(ids):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return [smallest.get(find(k)) for k in range(len(ids))]


def test_fingerprint(words):
    rng = random.Random(1)
    for text in [*EDGES, *(" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 4, 5, 300))]:
        assert S.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_edges(spark):
    docs = with_clashes(documents(spark, EDGES, ids=EDGE_IDS))
    prints = [plain_fingerprint(t) for t in EDGES]
    expected = sorted(zip(EDGE_IDS, [f"{p:016x}" for p in prints], plain_components(EDGE_IDS, prints)), key=str)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == expected
    assert S.near_duplicates(docs.where("false")).count() == 0
    stay = S.one_of_each(docs)
    assert stay.columns == docs.columns and S.one_of_each(docs.where("false")).count() == 0


def crowd(rng, n):
    """Fingerprints in dense and loose sets, with chains and shared blocks."""
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64) & ~0x1FFF if rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            out.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


@pytest.mark.parametrize("hot_rows", [4096, 40, 3])
def test_links_lose_nothing(spark, hot_rows):
    """Whatever is left to finer keys or to tiles, the same sets hang together."""
    prints = crowd(random.Random(hot_rows), 500)
    rows = spark.createDataFrame([(S._signed(p),) for p in prints], "fingerprint long")
    links = S.near_links(rows, hot_rows=hot_rows)
    roots = {r["node"]: r["component"] for r in connected_components(links).collect()}
    got = [roots.get(S._signed(p), S._signed(p)) for p in prints]
    expected = plain_components(list(range(len(prints))), prints)
    same = {}
    for g, e in zip(got, expected):
        assert same.setdefault(g, e) == e
    assert len(set(got)) == len(set(expected))


def test_keys_meet(spark):
    """Two fingerprints within the distance share a key, for every number of blocks."""
    rng = random.Random(2)
    for blocks in range(5, 9):
        pairs = []
        for _ in range(40):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(0, 4)):
                y ^= 1 << b
            pairs.append((S._signed(x), S._signed(y)))
        rows = spark.createDataFrame(pairs, "x long, y long")
        shared = [S.pivot_keys(rows.select(F.col(c).alias("fingerprint")), blocks).groupBy("fingerprint").agg(F.collect_set("key").alias("k")).collect() for c in "xy"]
        xs, ys = ({r["fingerprint"]: set(r["k"]) for r in x} for x in shared)
        assert all(xs[x] & ys[y] for x, y in pairs)


def test_dense_group_gives_a_star():
    prints = np.array([1 << i for i in range(40)], np.uint64)
    member, centre = S.links_within(np.zeros(40, np.int64), prints)
    assert len(member) == 39 and len(set(centre.tolist())) == 1


def test_one_stays_of_each_group(spark, words):
    rng = random.Random(3)
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(5)]
    texts = [base[i % 5] + (" more" if i % 2 else "") for i in range(40)]
    docs = documents(spark, texts)
    judged = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in S.one_of_each(docs).collect()) == sorted(i for i, c in judged.items() if i == c)
    assert S.one_of_each(docs).count() == 5


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(50)], [(5, 3), (3, 9), (9, 5), (20, 21), (21, 20), (20, 21)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
