import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import EDGE_IDS, EDGES, documents, with_clashes
from stemma.llm import chunks as C
from stemma.llm import linededup as L
from stemma.llm.cuckoo import CuckooFilter

WHITE = " \t\n\x0b\x0c\r"


def plain_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain_dedup(rows):
    """n_lines, n_dropped and the kept text of each row (id, text)."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = plain_key(line)
            if i is not None and len(k) >= 10:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(h := holders.get(plain_key(x), ())) >= 2 and min(h) != i for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def lined(rng, words, n):
    shared = [" ".join(rng.choice(words) for _ in range(4)) for _ in range(12)] + ["short", "exactly 10", "nine char"]
    out = []
    for _ in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(5)) for _ in range(rng.randint(1, 9))]
        out.append("\n".join(f"{rng.choice(['', ' ', chr(9)])}{x.title() if rng.random() < 0.2 else x}\r" for x in lines))
    return out


def report(docs, index=None):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in L.line_report(docs, index or L.LineIndex.build(docs)).collect()), key=str)


def expected(rows):
    return sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_dedup(rows)), key=str)


@pytest.mark.parametrize("part", [1_000_000, 7])
def test_report(spark, words, monkeypatch, part):
    """With the references of a shard asked for at once, and in parts."""
    monkeypatch.setattr(L, "PART_REFERENCES", part)
    texts = lined(random.Random(1), words, 120)
    assert report(documents(spark, texts)) == expected(list(enumerate(texts)))


def test_edges(spark):
    docs = with_clashes(documents(spark, EDGES, ids=EDGE_IDS))
    assert report(docs) == expected(list(zip(EDGE_IDS, EDGES)))
    assert report(docs.where("false")) == []
    kept = L.drop_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(EDGES) and L.drop_lines(docs.where("false")).count() == 0
    assert kept.where("text is null").count() == 2


def test_drop_lines_keeps_other_columns(spark, words):
    texts = lined(random.Random(2), words, 50)
    rows = {r["doc_id"]: r for r in L.drop_lines(with_clashes(documents(spark, texts))).collect()}
    for i, _, _, text in plain_dedup(list(enumerate(texts))):
        assert (rows[i]["text"], rows[i]["n_chars"], rows[i]["lost"]) == (text, len(text), "own")


def test_reversible(spark, words):
    """Inserting in batches and deleting gives the same as building from what is left."""
    texts = lined(random.Random(3), words, 90)
    docs = documents(spark, texts)
    index = L.LineIndex.build(docs.where("doc_id >= 60")).insert(docs.where("doc_id < 60"))
    assert report(docs, index) == expected(list(enumerate(texts)))
    index = index.insert(docs.where("doc_id < 10"))  # known already
    assert report(docs, index) == expected(list(enumerate(texts)))
    gone = docs.where("doc_id % 4 = 0")
    left = docs.where("doc_id % 4 <> 0")
    less = index.delete(gone.select("doc_id"))
    rows = [(i, t) for i, t in enumerate(texts) if i % 4]
    assert report(left, less) == expected(rows)
    assert report(docs, less.insert(gone)) == expected(list(enumerate(texts)))
    # Lines that only deleted documents held are unknown to every filter, up to chance.
    dead = L.references(gone).join(less.refs, ["hi", "lo"], "left_anti").select("hi", "lo").distinct().collect()
    filters = [CuckooFilter.from_bytes(bytes(r["filter"])) for r in less.filters.where("not shared").collect()]
    hi, lo = (np.array([r[c] for r in dead], np.int64) for c in ("hi", "lo"))
    assert sum(f.has(hi, lo) for f in filters).astype(bool).mean() < 0.05


def test_hot_line(spark):
    texts = [f"the same line in every document\nown line number {i}" for i in range(300)]
    assert report(documents(spark, texts)) == expected(list(enumerate(texts)))


@pytest.mark.parametrize("n", [1, 7, 1000, 60_000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, (2, n))
    f = CuckooFilter(n)
    full = f.add(*keys)
    assert not full.any() and f.has(*keys).all()
    other = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    assert f.has(*other).mean() < 0.002
    half = keys[:, : n // 2]
    back = CuckooFilter.from_bytes(f.to_bytes())
    assert not back.remove(*half).any()
    assert back.has(*keys[:, n // 2 :]).all() and back.has(*half).sum() <= 0.01 * n
    tiny = CuckooFilter(4)
    full = tiny.add(*rng.integers(-(2**63), 2**63 - 1, (2, 100)))
    assert full.sum() >= 100 - tiny.table.size and (tiny.table > 0).sum() == (~full).sum()


def plain_gear(data):
    out = []
    for i in range(len(data)):
        h = 0
        for age, byte in enumerate(data[max(0, i - 31) : i + 1][::-1]):
            h = (h + (int(C._GEAR[byte]) << age)) & 0xFFFFFFFF
        out.append(h)
    return out


def plain_boundaries(data, level):
    h, start, ends = plain_gear(data), 0, []
    if len(data) <= level.least:
        return [len(data)] if data else []
    for i in range(1, len(data) + 1):
        size = i - start
        bits = level.strict if size < level.normal else level.loose
        if i == len(data) or (size >= level.least and h[i - 1] < 1 << (32 - bits)) or size == level.most:
            ends.append(i)
            start = i
    return ends


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 64, 500, 4000])
def test_boundaries(n):
    rng = random.Random(n)
    for data in (bytes(rng.choice(b"abcdefgh ") for _ in range(n)), b"a" * n):
        for level in (C.COARSE, C.FINE):
            assert C.boundaries(data, level) == plain_boundaries(data, level)
            assert sum(C.chunk_set(data, level).values()) <= n
        assert (C.fingerprint(data)[1] is None) == (n >= C.SHORT)


def test_shift_resistance(words):
    rng = random.Random(4)
    text = " ".join(rng.choice(words) for _ in range(3000)).encode()
    whole = C.fingerprint(text)
    assert C.parse(C.render(whole)) == whole and C.likeness(whole, whole) == 1
    assert C.likeness(whole, C.fingerprint(b"some words before " + text)) > 0.97
    assert C.likeness(whole, C.fingerprint(text[: len(text) // 2])) == pytest.approx(0.5, abs=0.03)
    nothing = C.fingerprint(b"")
    assert (C.likeness(nothing, nothing), C.likeness(nothing, whole), C.likeness(whole, nothing)) == (1.0, 0.0, 0.0)


@pytest.mark.parametrize("n,least", [(90, 0.6), (150, 0.8), (400, 0.95)])
def test_short_texts_show_what_stays(words, n, least):
    """Of texts of ``n`` characters whose last half is replaced, most are told from strangers."""
    rng = random.Random(n)
    made = lambda: " ".join(rng.choice(words) for _ in range(n))[:n].encode()
    texts = [made() for _ in range(200)]
    assert all(C.parse(C.render(f)) == f for f in map(C.fingerprint, texts))
    near = [C.likeness(C.fingerprint(t), C.fingerprint(t[: n // 2] + made()[: n // 2])) for t in texts]
    assert sum(x > 0 for x in near) >= least * 200 and max(near) < 0.9
    assert sum(C.likeness(C.fingerprint(a), C.fingerprint(b)) for a, b in zip(texts, texts[1:])) == 0


@pytest.mark.parametrize("block", [1, 3000, 1 << 24])
def test_report_of_chunks(spark, words, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 200]))) + rng.choice(["", "é漢😀"]) for _ in range(60)]
    ids = rng.sample(range(-50, 1000), 60)
    check_chunks(C.fingerprint_report(documents(spark, texts, ids=ids)).collect(), sorted(zip(ids, texts)))


def check_chunks(rows, ordered):
    assert len(rows) == len(ordered)
    expected = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b = C.fingerprint(t.encode()), C.fingerprint(e.encode())
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), C.render(a), C.render(b), C.likeness(a, b), C.likeness(a, C.fingerprint(after.encode()))))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("block", [1, 1 << 24])
def test_edges_of_chunks(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    docs = with_clashes(documents(spark, EDGES, ids=EDGE_IDS))
    ordered = sorted(zip(EDGE_IDS, EDGES), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    check_chunks(C.fingerprint_report(docs).collect(), ordered)
    assert C.fingerprint_report(docs.where("false")).count() == 0
    check_chunks(C.fingerprint_report(documents(spark, ["only one text"])).collect(), [(0, "only one text")])
    check_chunks(C.fingerprint_report(documents(spark, ["a", "b"], ids=[None, None])).collect(), [(None, "a"), (None, "b")])
    broken = spark.range(2).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF62' as string)").alias("text"))
    check_chunks(C.fingerprint_report(broken).collect(), [(0, "a\ufffdb"), (1, "a\ufffdb")])
