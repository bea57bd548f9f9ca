import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from conftest_llm import EDGE_IDS, EDGES, documents, with_clashes

import corpus_pipeline
from stemma.llm import overlap
from stemma.shared import shared_root


def plain_set(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_stay(texts):
    sets, root = list(map(plain_set, texts)), list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
            x, y = sorted((root[i], root[j]))
            root = [x if r == y else r for r in root]
    return sorted(set(root))


def near_copies(words):
    rng = random.Random(8)
    texts = []
    for n in (3, 6, 20, 60, 200, 500):
        for _ in range(3):
            text = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(text))
            for part in (0.005, 0.01, 0.02, 0.03, 0.05):
                texts.append(" ".join(w if rng.random() > part else "other" for w in text))
            texts.append(" ".join(text[: int(n * 0.82)]))
            texts.append(" ".join(text).upper())
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot", [4096, 2])
def test_near_copies_go(spark, words, hot):
    texts = near_copies(words) + ["", " \n", None]
    assert sorted(r["doc_id"] for r in overlap.one_of_each(documents(spark, texts), hot_rows=hot).collect()) == plain_stay(texts)


def test_stage_follows_the_rule(spark, words):
    texts = near_copies(words)
    docs = documents(spark, texts)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == plain_stay(texts)


def test_limits():
    assert [overlap.prefix_length(n) for n in (0, 1, 4, 5, 6, 10)] == [0, 1, 1, 2, 2, 3]
    assert overlap.near_enough(4, 5, 4) and not overlap.near_enough(79, 100, 78 + 1 + 20)


def test_edges_of_overlap(spark):
    docs = with_clashes(documents(spark, EDGES, ids=EDGE_IDS))
    stay = overlap.one_of_each(docs)
    assert stay.columns == docs.columns and overlap.one_of_each(docs.where("false")).count() == 0
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == [0, 3, 4, 4, 7, 8, None, None]


def test_simhash_links_of_the_stage(spark, words):
    """The sets that the first look links hang together as their fingerprints do, by all pairs."""
    texts = near_copies(words)
    rows = {r["node"]: r["fingerprint"] for r in overlap._prefixes(documents(spark, texts)).collect()}
    nodes = list(rows)
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    def joined(pairs):
        root.update({n: n for n in nodes})
        for a, b in pairs:
            root[top(a)] = top(b)
        groups = {}
        for n in nodes:
            groups.setdefault(top(n), set()).add(n)
        return sorted(map(sorted, groups.values()))

    plain = joined((a, b) for a, b in combinations(nodes, 2) if bin((rows[a] ^ rows[b]) & (1 << 64) - 1).count("1") <= 4)
    frame = spark.createDataFrame(list(rows.items()), "node long, fingerprint long")
    assert joined(map(tuple, overlap.simhash_pairs(frame).collect())) == plain and len(plain) < len(nodes)


def judged_pairs(monkeypatch):
    """How many pairs each look of the stage has to judge, in the order of the looks."""
    seen, possible = [], overlap._possible

    def counted(pairs, classes):
        seen.append(pairs.count())
        return possible(pairs, classes)

    monkeypatch.setattr(overlap, "_possible", counted)
    return seen


def test_shared_passages_make_no_pairs(spark, words, monkeypatch):
    """Texts that have only a passage in common are not paired with each other, and no near copy is lost for it."""
    rng = random.Random(9)
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage = some(40)
    texts = [" ".join(some(30) + passage + some(30)) for _ in range(600)]
    near = [" ".join(t.split()[:-2]) for t in texts[:40]]
    seen = judged_pairs(monkeypatch)
    stay = sorted(r["doc_id"] for r in overlap.one_of_each(documents(spark, texts + near)).collect())
    assert stay == plain_stay(texts + near) == list(range(600))
    assert sum(seen) < 600
    # Of texts that are all passage, the common shingles are the first ones too.
    alike = [" ".join(passage + some(n % 9)) for n in range(150)]
    assert sorted(r["doc_id"] for r in overlap.one_of_each(documents(spark, alike + texts[:50] + near)).collect()) == plain_stay(alike + texts[:50] + near)


def test_order_of_shingles():
    few = np.arange(10, 110, 10, dtype=np.uint64)
    common = (np.array([10, 20, 25, 30], np.uint64), np.array([2, 0, 1, 3]))
    assert overlap.prefix(few, common).tolist() == [40, 50, 60] and overlap.prefix(few[:4], common).tolist() == [40]
    assert overlap.prefix(few[:3], common).tolist() == [20] and overlap.prefix(few[:0], common).tolist() == []
    assert overlap.prefix(few, (common[0][:0], common[1][:0])).tolist() == [10, 20, 30]


def test_simhash_spares_the_exact_search(spark, words, monkeypatch):
    """A dense group that SimHash links is not paired again."""
    rng = random.Random(10)
    text = [rng.choice(words) for _ in range(1000)]
    texts = [" ".join(text[:i] + ["other"] + text[i + 1 :]) for i in range(100, 900, 10)]
    seen = judged_pairs(monkeypatch)
    assert [r["doc_id"] for r in overlap.one_of_each(documents(spark, texts)).collect()] == [0]
    assert sum(seen) < len(texts) * 5


def test_disk_of_the_stage(spark, words):
    """Of the tables of the stage one narrow table stays, and settings are as before."""
    rng = random.Random(11)
    docs = documents(spark, [" ".join(rng.choice(words) for _ in range(80)) for _ in range(50)])
    at = Path(shared_root(spark).removeprefix("file://"), "stemma", spark.sparkContext.applicationId)
    before = {p.name for p in at.iterdir()} if at.exists() else set()
    settings = spark.conf.getAll
    stay = overlap.one_of_each(docs)
    assert [n.rpartition("-")[0] for n in {p.name for p in at.iterdir()} - before] == ["set-components"]
    assert spark.conf.getAll == settings and stay.count() == 50
