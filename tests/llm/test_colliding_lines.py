import numpy as np
import pytest
from conftest_llm import documents
from pyspark.sql import functions as F

from stemma.llm import cuckoo as C
from stemma.llm import linededup as L


@pytest.fixture(scope="module")
def colliding(spark):
    """Two lines of one shard of four with the same mark and bucket in a filter of four buckets, and others of that shard."""
    lines = [f"a line with the number {i}" for i in range(30_000)]
    halves = np.array([np.frombuffer(L.line_key(line.encode()), "<i8") for line in lines])
    rows = spark.createDataFrame([(i, int(h), int(lo)) for i, (h, lo) in enumerate(halves)], "i int, hi long, lo long")
    shard = dict(map(tuple, rows.select("i", F.pmod(F.hash("hi", "lo"), F.lit(4))).collect()))
    met = {}
    for i, (hi, lo) in enumerate(halves):
        place = (shard[i], int(lo) >> 48, int(hi) & 3)
        # Buckets of a large filter must differ.
        if place in met and (int(halves[met[place]][0]) ^ int(hi)) & 1023:
            x, y = met[place], i
            others = [j for j in range(30_000) if shard[j] == shard[x] and j not in (x, y)]
            return lines[x], lines[y], [lines[j] for j in others[:60]]
        met.setdefault(place, i)


def dropped(index):
    return sorted(map(tuple, index.drops().collect()))


def ids(spark, *of):
    return spark.createDataFrame([(i,) for i in of], "doc_id long")


@pytest.mark.parametrize("first", [0, 1])
def test_marks_that_collide(spark, colliding, first):
    x, y, _ = colliding
    texts = [x, y, x, y]
    docs = documents(spark, texts)
    index = L.LineIndex.build(docs.where("doc_id = 0")).insert(docs.where("doc_id = 1"))
    left = 1 - first
    index = index.delete(ids(spark, first)).insert(docs.where(F.col("doc_id") == left + 2))
    assert dropped(index) == dropped(L.LineIndex.build(docs.where(F.col("doc_id").isin(left, left + 2)))) != []


def test_filters_of_one_shard(spark, colliding):
    x, y, others = colliding
    docs = documents(spark, [x, "\n".join(others), y, x])
    index = L.LineIndex.build(docs.where("doc_id = 0")).insert(docs.where("doc_id = 1")).insert(docs.where("doc_id = 2"))
    assert index.filters.where("not shared").groupBy("shard").count().agg(F.max("count")).first()[0] > 1
    index = index.delete(ids(spark, 2)).insert(docs.where("doc_id = 3"))
    assert dropped(index) == dropped(L.LineIndex.build(docs.where("doc_id <> 2"))) != []


@pytest.mark.parametrize("marks,shard_keys,segments", [(3, 400_000, 16), (3, 20, 1)])
def test_any_history_is_a_build(spark, monkeypatch, marks, shard_keys, segments):
    """With marks of two bits nearly every key is seen by chance and filters overflow; what is dropped stays what a build drops."""
    monkeypatch.setattr(C, "MARKS", marks)
    monkeypatch.setattr(L, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(L, "SEGMENTS", segments)
    rng = np.random.default_rng(marks + shard_keys)
    lines = [f"one of the lines of number {i}" for i in range(150)]
    texts = ["\n".join(rng.choice(lines, rng.integers(1, 9))) for _ in range(60)]
    docs = documents(spark, texts)
    index, held = L.LineIndex.build(docs.where("doc_id < 10")), set(range(10))
    for step in range(3):
        new = {int(i) for i in rng.choice(60, 15)}
        index, held = index.insert(docs.where(F.col("doc_id").isin(sorted(new)))), held | new
        old = {int(i) for i in rng.choice(sorted(held), 8)}
        index, held = index.delete(ids(spark, *old)), held - old
        if step:
            built = L.LineIndex.build(docs.where(F.col("doc_id").isin(sorted(held))))
            assert dropped(index) == dropped(built) != []
            assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, built.counts.collect()))


def test_filters_open_another_when_full():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    small = C.CuckooFilter(100)
    made = C.filled(*keys, [small], 8000)
    assert len(made) == 2 and np.count_nonzero(small.table) <= C.LOAD * small.table.size
    assert L._seen(*keys, made).all()
