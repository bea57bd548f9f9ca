import gzip
import io
import os
import random
import tarfile
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stemma.engine import Engine
from stemma.operators import associate as A
from stemma.operators import blocks as B
from stemma.operators import documents as D
from stemma.operators import index as I
from stemma.operators import search as S
from stemma.plans import jobs
from stemma.plans.config import EngineConfig
from stemma.sources.files import file_documents, members, read_files, text_document
from stemma.sources.synthetic import synthetic_documents
from stemma.streaming import feeds

SMALL = EngineConfig(window=8, slack=3, hash_width=24, shards=2, min_hits=2, limit=None)
COLUMNS = "doctype long, docid long, title string, text string, characters long, valid boolean, meta map<string,array<string>>"


def documents(spark, rows):
    return spark.createDataFrame([(t, d, "title", x, len(x), True, {}) for t, d, x in rows], COLUMNS)


def plain_runs(a, b, size, least):
    """Maximal runs of equal windows on one diagonal, blank windows left out."""
    out = []
    for diagonal in range(-len(b), len(a) + 1):
        run = []
        for i in range(max(0, diagonal), len(a) - size + 1):
            j = i - diagonal
            same = j + size <= len(b) and a[i : i + size] == b[j : j + size] and a[i : i + size].strip(" ")
            if same:
                run.append(i)
            if (not same or i == len(a) - size) and run:
                out.append((run[0], run[0] - diagonal, len(run) - 1 + size))
                run = []
    cut = []
    for i, j, n in out:
        if n >= least:
            t = a[i : i + n]
            lead = len(t) - len(t.lstrip(" "))
            if len(t.strip(" ")) >= least:
                cut.append((i + lead, j + lead, len(t.strip(" ")), t.strip(" ")))
    return sorted(cut)


def test_fragments_against_plain(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  é") for _ in range(rng.randint(0, 60))) for _ in range(14)] + ["", "abababababab", " " * 30, "ab " * 10]
    normal = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    left = A.prepared(normal, "id")
    upper = {r["id"]: r["normal"] for r in left.collect()}
    got = {}
    for r in A.associate(left, left, SMALL).collect():
        got.setdefault((r["left_id"], r["right_id"]), []).append((r["left"], r["right"], r["length"], r["text"]))
    for a in upper:
        for b in upper:
            assert sorted(got.get((a, b), [])) == plain_runs(upper[a], upper[b], 5, 8), (a, b)
    pairs = spark.createDataFrame([(a, b) for a in upper for b in upper if (a + b) % 3], "left_id long, right_id long")
    wanted = {}
    for r in A.associate(left, left, SMALL, pairs).collect():
        wanted.setdefault((r["left_id"], r["right_id"]), []).append((r["left"], r["right"], r["length"], r["text"]))
    assert {k: sorted(v) for k, v in wanted.items()} == {k: sorted(v) for k, v in got.items() if sum(k) % 3}
    for places in (1, 2, 7, 50):  # however the right text is cut
        for a, b in ((17, 17), (15, 17), (3, 4), (15, 15)):
            assert sorted(A.pair_runs(upper[a], upper[b], 5, places)) == sorted(A.pair_runs(upper[a], upper[b], 5))


def test_boilerplate_makes_no_unwanted_places(spark, monkeypatch):
    """Only wanted pairs are compared, however many texts share a passage."""
    line = "this line stands in every document"
    side = A.prepared(spark.createDataFrame([(i, f"{line} and this in number {i} {'xyz' * (i % 5)}") for i in range(1000)], "id long, text string"), "id")
    wanted = [(i, (7 * i + 1) % 1000) for i in range(40)]
    seen = spark.sparkContext.accumulator(0)
    plain = A.pair_runs

    def counted(*args):
        seen.add(1)
        return plain(*args)

    monkeypatch.setattr(A, "pair_runs", counted)
    rows = A.associate(side, side, SMALL, spark.createDataFrame(wanted * 2, "left_id long, right_id long")).select("left_id", "right_id").distinct().collect()
    assert sorted(map(tuple, rows)) == sorted(wanted) and seen.value == len(wanted)


def test_theme_ids():
    from stemma.functions.hashing import theme_id, theme_ids

    rng = random.Random(3)
    texts = ["".join(rng.choice("aé漢 ") for _ in range(rng.choice([0, 1, 5, 40, 3000]))) for _ in range(150)]
    assert theme_ids(texts).tolist() == [theme_id(t) for t in texts]
    assert theme_ids([]).tolist() == [] and theme_ids(["x" * 999]).tolist() == [theme_id("x" * 999)]


def test_symmetry_and_listing(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps, over it"), (2, "QUICK BROWN FOX! and a lazy dog"), (3, "nothing here")], "id long, text string")
    side = A.prepared(texts, "id")
    found = A.associate(side, side, SMALL, exclude_self=True)
    one = {(r["left_id"], r["right_id"], r["left"], r["right"], r["length"]) for r in found.collect()}
    two = {(r["left_id"], r["right_id"], r["left"], r["right"], r["length"]) for r in A.flipped(found).collect()}
    assert one == two and {x[:2] for x in one} == {(1, 2), (2, 1)}
    listed = A.associations(found).where("left_id = 1").first()
    lengths = [f["length"] for f in listed["fragments"]]
    assert lengths == sorted(lengths, reverse=True) and listed["fragment_count"] == len(lengths)
    assert A.themes(found).count() == len({r["text"] for r in found.collect()})


def test_large_left_side_is_not_sent(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"common words in text {i % 3} of all") for i in range(9)], "id long, text string")
    side = A.prepared(rows, "id")
    keys = lambda df: sorted(tuple(r) for r in df.collect())
    sent = keys(A.associate(side, side, SMALL))
    monkeypatch.setattr(A, "SENT_HASHES", 3)
    assert keys(A.associate(side, side, SMALL)) == sent


def test_shared_places_shuffle_only_the_left_sides_windows(spark, monkeypatch):
    rng = random.Random(9)
    passage = "a passage that texts of both sides have"
    left = A.prepared(spark.createDataFrame([(1, passage), (2, "nothing of it is anywhere else")], "id long, text string"), "id")
    rows = [(i, "".join(rng.choice("klmnopqr") for _ in range(500)) + passage * (i % 2)) for i in range(20)]
    right = A.prepared(spark.createDataFrame(rows, "id long, text string"), "id")
    made, windows = [], A._windows
    monkeypatch.setattr(A, "_windows", lambda *a, **b: made.append(windows(*a, **b)) or made[-1])
    assert [tuple(r) for r in A.shared_windows(left, right, SMALL).collect()] == [(1, len(passage) - 4)]
    assert made[1].count() == 10 * (len(passage) - 4)
    monkeypatch.setattr(A, "SENT_HASHES", 3)
    assert [tuple(r) for r in A.shared_windows(left, right, SMALL).collect()] == [(1, len(passage) - 4)]


def plain_search(query, texts, config):
    from stemma.functions.hashing import window_hashes

    size, out = config.shard_size, []
    probes = window_hashes(query, config.window, config.hash_width).tolist()
    for key, text in texts.items():
        held = set(window_hashes(text, config.window, config.hash_width).tolist())
        n = s = q = 0
        for shard in range(config.shards):
            at = [i for i, h in enumerate(probes) if h // size == shard and h in held]
            steps = [b - a for a, b in zip(at, at[1:])]
            if len(at) >= config.min_hits and sum(steps) > 0:
                n, s, q = n + len(at), s + sum(steps), q + sum(x * x for x in steps)
        if n:
            out.append((max(q / n - (s / n) ** 2, 0) ** 0.5 / n, *key))
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 2, 4])
def test_search_against_plain(spark, shards):
    config = replace(SMALL, shards=shards)
    rng = random.Random(shards)
    rows = [(1 + i % 3, i + 1, " ".join(rng.choice(["river", "stone", "winter", "copper"]) for _ in range(12))) for i in range(12)]
    docs = documents(spark, rows)
    queries = spark.createDataFrame([(7, rows[0][2][5:50])], "query_id long, text string")
    got = S.search(queries, I.build_index(docs, config), config).orderBy("rank").collect()
    expected = plain_search(rows[0][2][5:50].upper(), {(t, d): x.upper() for t, d, x in rows}, config)
    assert [(r["doctype"], r["docid"]) for r in got] == [e[1:] for e in expected]
    assert all(abs(r["score"] - e[0]) < 1e-9 for r, e in zip(got, expected))
    limited = S.search(queries, I.build_index(docs, config), replace(config, limit=2), target="1:3").collect()
    assert len(limited) <= 2 and all(r["doctype"] in (1, 3) for r in limited)
    with pytest.raises(ValueError):
        S.check_query("short", config)


@pytest.mark.parametrize("width,shards,block", [(12, 2, 300), (24, 4, 300), (30, 1, 1 << 23), (64, 2, 300)])
def test_search_of_texts_is_that_of_their_index(spark, monkeypatch, width, shards, block):
    """Texts of which there is no index are searched in pairs of blocks; only strong tallies leave a task."""
    config = replace(SMALL, hash_width=width, shards=shards, min_hits=4)
    rng = random.Random(width)
    docs = documents(spark, [(1 + i % 3, i + 1, " ".join(rng.choice(["river", "stone", "winter", "copper"]) for _ in range(rng.randint(1, 30)))) for i in range(40)])
    queries = docs.where("docid % 4 = 0").select(F.col("docid").alias("query_id"), "text", F.col("doctype").alias("own_doctype"), F.col("docid").alias("own_docid"))
    monkeypatch.setattr(B, "BLOCK", block)
    for own in (False, True):
        rows = lambda df: sorted(tuple(r) for r in df.drop("stddev").withColumns({c: F.round(c, 9) for c in ("mean", "score")}).select(sorted(df.drop("stddev").columns)).collect())
        got = rows(S.search_texts(queries, docs, config, "1:3", own))
        assert got == rows(S.search(queries, I.build_index(docs, config), config, "1:3", own)) and len(got) > 50
    assert S.text_tallies(queries, docs, config).agg(F.min("count")).first()[0] >= 4
    texts = [r["text"].upper() for r in docs.collect()]
    whole = [x.tolist() for x in B.Probes(texts, config).strong(texts[0] * 3)]
    monkeypatch.setattr(B, "HITS", 50)
    assert [x.tolist() for x in B.Probes(texts, config).strong(texts[0] * 3)] == whole and whole[0]


@pytest.mark.parametrize("width,shards", [(64, 1), (64, 4), (40, 4)])
def test_wide_hashes(spark, width, shards):
    """Wide hashes find what narrow ones find, without the documents that only share a hash."""
    config = replace(SMALL, hash_width=width, shards=shards, min_hits=1)
    docs = documents(spark, [(1, i + 1, f"river and stone in winter, number {i % 4} of all") for i in range(12)])
    postings = I.build_index(docs, config)
    queries = spark.createDataFrame([(0, "stone in winter, number 3")], "query_id long, text string")
    hits = S.hits(queries, postings, config).select(I.shard(config).alias("shard")).distinct().collect()
    assert {r["shard"] for r in hits} <= set(range(shards))
    assert {r["docid"] for r in S.search(queries, postings, replace(config, shards=1, min_hits=18)).collect()} == {4, 8, 12}


def test_index_round_trip(spark):
    docs = documents(spark, [(1, 1, "abcdefghijklmnop"), (1, 2, "abcdefghijklxyz"), (2, 1, "short"), (2, 2, "abcdefgh")])
    postings = I.build_index(docs, SMALL)
    assert postings.groupBy("docid", "doctype").count().count() == 2  # texts of one window at most have none
    less = I.delete_from_index(postings, docs.where("docid = 2"))
    assert less.select("doctype", "docid").distinct().count() == 1
    again = I.add_to_index(less, docs.where("docid = 2"), SMALL)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, postings.collect()))
    capped = S.hits(spark.createDataFrame([(0, "abcdefghijkl")], "query_id long, text string"), postings, replace(SMALL, max_docs_per_hash=1))
    assert capped.count() == 0


def test_posting_counts_are_those_of_the_index(spark):
    """One row leaves a task for each document, not for each posting."""
    docs = documents(spark, [(1, 1, "abcdefghijklmnop" * 3), (1, 2, "abcdefghijklxyz"), (2, 1, "short"), (2, 2, "abcdefgh"), (2, 3, "abcdefghi")])
    rows = I.posting_counts(docs, SMALL).collect()
    expected = {(r["doctype"], r["docid"]): r["count"] for r in I.build_index(docs, SMALL).groupBy("doctype", "docid").count().collect()}
    assert len(rows) == len(expected) == 3 and {(r["doctype"], r["docid"]): r["postings"] for r in rows} == expected


@pytest.mark.parametrize("start,limit", [(0, 5), (5_000_000, 20), (0, 10_000), ((1 << 24) - 1, 3)])
def test_lines_of_texts_are_those_of_their_index(spark, start, limit):
    """A task gives away the postings of its lowest hashes only."""
    rng = random.Random(limit)
    docs = documents(spark, [(1 + i % 2, i + 1, "".join(rng.choice("abc ") for _ in range(200)) + "x" * (i % 30)) for i in range(150)])
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(I.list_texts(docs, SMALL, start, limit)) == rows(I.list_index(I.build_index(docs, SMALL), start, limit))
    low = I.lowest_of_texts(docs, SMALL, start, limit).groupBy(F.spark_partition_id()).agg(F.countDistinct("hash").alias("n"))
    assert all(r["n"] <= limit for r in low.collect())


def test_line_stats_of_texts_are_those_of_their_index(spark):
    """Packs of postings are shuffled, a row for each bucket of hashes and not for each posting."""
    rng = random.Random(3)
    rows = [(1 + i % 300, 1 + i * 97, "".join(rng.choice("abc ") for _ in range(200)) + "x" * (i % 30)) for i in range(400)]
    for width in (16, 20, 24):
        config = replace(SMALL, hash_width=width, shards=1 if width == 16 else 2)
        docs = documents(spark, rows)
        got = sorted(tuple(r) for r in I.text_line_stats(docs, config, 40).collect())
        assert got == sorted(tuple(r) for r in I.line_stats(I.build_index(docs, config), config, 40).collect())
        assert sum(r[4] for r in got) > 0


def test_posting_line_bytes(spark):
    """A line's bytes as ids are added one after the other."""
    steps = [(1, 1), (1, 2), (1, 300), (1, 301), (2, 1), (2, 200000), (300, 5)]

    def varint(v):
        return next(n for n in range(1, 6) if v < 1 << (7 * n))

    for n in range(1, len(steps) + 1):
        rows = spark.createDataFrame([(5, t, d) for t, d in steps[:n]], "hash long, doctype long, docid long")
        expected = 1
        for t in {t for t, _ in steps[:n]}:
            ids = sorted(d for x, d in steps[:n] if x == t)
            size = sum(varint(b - a) for a, b in zip([0, *ids], ids))
            expected += varint(t) + varint(size) + size
        assert I.posting_lines(rows).first()["bytes"] == expected


def test_documents(spark):
    rows = spark.createDataFrame([(1, 1, "t", "text"), (0, 1, "t", "x"), (1, 0, "t", "x"), (1, 2, "", "x"), (1, 3, "t", None), (1, 4, "t", "ß😀")], "a long, b long, t string, x string")
    built = D.build_documents(rows, F.col("a"), F.col("b"), F.col("t"), F.col("x"), {"k": F.col("t")})
    assert sorted((r["docid"], r["characters"]) for r in built.collect()) == [(1, 4), (4, 2)]
    new = documents(spark, [(1, 1, "newer"), (9, 9, "other")])
    merged = D.upsert(built, new)
    assert sorted((r["doctype"], r["docid"], r["text"]) for r in merged.collect()) == [(1, 1, "newer"), (1, 4, "ß😀"), (9, 9, "other")]
    assert D.delete(merged, new).count() == 1
    assert D.get(merged, 9, 9).count() == 1
    wanted = spark.createDataFrame([(9, 9, 0), (5, 5, 1), (1, 1, 2)], "doctype long, docid long, rank int")
    assert [r["doctype"] for r in D.get_many(merged, wanted).collect()] == [9, 1]


@pytest.mark.parametrize("options,total,shown", [({"limit": 20, "doctypes": "1"}, 20, 20), ({"limit": 20}, 200, 20), ({"limit": 40, "doctypes": "1:4-5"}, 60, 40)])
def test_listing(spark, options, total, shown):
    page, n = D.list_documents(synthetic_documents(spark, 10, 20, 50), order_by=["-doctype"], **options)
    rows = page.collect()
    assert (n, len(rows)) == (total, shown) and "text" not in page.columns
    assert [r["doctype"] for r in rows] == sorted((r["doctype"] for r in rows), reverse=True)


def test_docid_counts(spark):
    corpus = synthetic_documents(spark, 10, 20, 20)
    for text, n in (("1-10", 200), ("1:10", 40), ("1", 20), ("", 200), ("999", 0)):
        assert D.docids(corpus, text).count() == n
    words = corpus.select(F.size(F.split("title", " ")).alias("t"), F.size(F.split("text", " ")).alias("x")).agg(F.min("t"), F.max("t"), F.min("x"), F.max("x")).first()
    assert 5 <= words[0] <= words[1] <= 9 and 100 <= words[2] <= words[3] <= 119


def archives(folder):
    os.makedirs(f"{folder}/sub/.git")
    write = lambda name, data: open(f"{folder}/{name}", "wb").write(data)
    write("a.txt", b"plain")
    write(".hidden", b"no")
    write("sub/.git/x", b"no")
    write("sub/b.txt.gz", gzip.compress(b"zipped"))
    tar, inner = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
        z.writestr(".no", "no")
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for name, data in (("one.txt", b"one"), ("dir/two.zip", inner.getvalue())):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    write("sub/c.tar.gz", tar.getvalue())
    write("broken.zip", b"not a zip")


def test_files(spark, tmp_path):
    archives(tmp_path)
    got = file_documents(spark, str(tmp_path), doctype=3).collect()
    assert sorted((r["title"], r["text"]) for r in got) == [("a.txt", "plain"), ("b.txt", "zipped"), ("deep.txt", "deep"), ("one.txt", "one")]
    assert {r["doctype"] for r in got} <= {3, 4, 5, 6} and len({(r["doctype"], r["docid"]) for r in got}) == 4
    assert text_document(spark, "typed").first()["text"] == "typed"
    assert list(members("/x/.dot", b"a")) == []
    errors = {r["name"]: (r["text"], r["error"]) for r in read_files(spark, str(tmp_path)).where("error is not null").collect()}
    assert set(errors) == {"broken.zip"} and errors["broken.zip"][0] is None and "zip" in errors["broken.zip"][1].lower()
    with open(tmp_path / "sub" / "c.tar.gz", "rb") as file:
        whole = gzip.decompress(file.read())
    found = list(members("/x/cut.tar", whole[:1500]))
    assert found[0][:2] == ("/x/cut.tar/one.txt", b"one") and found[-1][1] is None and found[-1][2]


def test_jobs(spark):
    empty = spark.createDataFrame([], jobs.SCHEMA)
    item = "nth int, command string, source_doctype long, source_docid long, source_range string, target_range string, payload binary"
    rows = [(i, "Add Document" if i != 2 else "Delete Document", 1, i, "", "", bytearray(jobs.pack({"title": "t", "text": f"x {i}"}))) for i in range(4)]
    queue = jobs.enqueue(jobs.enqueue(empty, spark.createDataFrame(rows[:1], item)), spark.createDataFrame(rows[1:], item))
    assert [r["id"] for r in jobs.listing(queue).collect()] == [1, 2, 3, 4]
    assert [r["id"] for r in jobs.next_batch(queue).collect()] == [1, 2]
    assert jobs.unpack(queue.where("id = 2").first()["payload"]) == {"title": ["t"], "text": ["x 1"]}
    assert jobs.marks(spark.createDataFrame([], jobs.STATUSES), {1: (jobs.STARTED, None)}).first()["nth"] == 1
    started = jobs.marks(spark.createDataFrame([], jobs.STATUSES), {1: (jobs.STARTED, None), 2: (jobs.STARTED, None)})
    ended = started.unionByName(jobs.marks(started, {1: (jobs.COMPLETED, None), 2: (jobs.COMPLETED, None)}))
    assert jobs.current(queue, started).where("id = 1").first()["payload"] is not None
    done = jobs.current(queue, ended)
    assert {r["status"]: r["count"] for r in jobs.stats(done).collect()} == {"Queued": 2, "Completed": 2}
    assert done.where("id = 1").first()["payload"] is None
    assert [r["location"] for r in jobs.location(done).orderBy("id").collect()] == ["/document/1/0/", "/document/1/1/"]
    assert jobs.next_batch(done).first()["command"] == "Delete Document"


def test_feed(spark, tmp_path):
    import json

    lines = [{"event_id": i, "doctype": 1 + i % 2, "data": json.dumps({"title": f"t{i}", "text": "some text", "tag": "x", "list": [1]})} for i in range(8)]
    lines += [{"event_id": 20, "doctype": 1, "data": ""}, {"event_id": 21, "doctype": 1, "data": "{broken"}, {"event_id": 22, "doctype": 1, "data": '{"title": "no text"}'}]

    def put(name, rows):
        os.makedirs(tmp_path / "in", exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))

    def run():
        feeds.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).orderBy("doctype", "docid").collect()

    put("a.json", lines[:5])
    assert len(run()) == 5
    put("b.json", lines[3:])  # some events come again
    rows = run()
    assert [(r["doctype"], r["docid"], r["event_id"]) for r in rows] == [(1, 1, 0), (1, 2, 2), (1, 3, 4), (1, 4, 6), (2, 1, 1), (2, 2, 3), (2, 3, 5), (2, 4, 7)]
    assert rows[0]["meta"] == {"tag": ["x"]}


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), replace(SMALL, min_hits=2))
    texts = {(1, 1): "the labourer is worthy of his hire", (1, 2): "truly the labourer is worthy of more", (2, 1): "a different text altogether, with no link"}
    for (t, d), x in texts.items():
        engine.enqueue("Add Document", t, d, values={"title": f"{t}-{d}", "text": x, "tag": "k"})
    assert engine.run_jobs() == {"Completed": 3, "Failed": 0} and engine.list_documents()[1] == 3
    assert engine.get_document(1, 2).first()["meta"] == {"tag": ["k"]}
    found = engine.search("The labourer is worthy!").collect()
    assert {(r["doctype"], r["docid"]) for r in found} == {(1, 1), (1, 2)} and found[0]["fragment_count"] == 1
    assert engine.list_index(limit=3).count() == 3
    assert {(r["doctype"], r["docid"]) for r in engine.search_document(1, 1).collect()} == {(1, 1), (1, 2)}
    assert {(r["doctype"], r["docid"]) for r in engine.search_document(1, 1, "1", exclude_self=True).collect()} == {(1, 2)}
    assert engine.search_document(1, 1, "2", exclude_self=True).count() == 0
    with pytest.raises(ValueError):
        engine.search_document(8, 8)
    for _ in range(2):  # running it again changes nothing
        engine.enqueue("Associate Document", source="1", target="1-2")
        engine.run_jobs()
        assert {(r["docid"], r["other_docid"]) for r in engine.list_associations("1").collect()} == {(1, 2), (2, 1)}
    engine.enqueue("Delete Document", 1, 2)
    engine.enqueue("Add Document", 5, 5, values={"title": "", "text": "x"})
    engine.run_jobs()
    assert {(r["doctype"], r["docid"]) for r in engine.search("The labourer is worthy!").collect()} == {(1, 1)}
    assert {r["status"]: r["count"] for r in engine.queue_stats().collect()} == {"Completed": 6, "Failed": 1}
    with pytest.raises(ValueError):
        engine.enqueue("Nothing")
    engine.drop()
    assert engine.list_documents()[1] == 0


def test_jobs_end_one_by_one(spark, tmp_path):
    """One bad job of ten leaves the other nine completed, each with its own status, error and place."""
    engine = Engine(spark, str(tmp_path / "store"), SMALL)
    for i in range(1, 11):
        assert engine.enqueue("Add Document", 1, i, values={"title": "" if i == 4 else "t", "text": f"text of number {i}"}) == i
    assert engine.run_jobs() == {"Completed": 9, "Failed": 1} and engine.list_documents()[1] == 9
    bad, good = engine.queue_item(4).first(), engine.queue_item(5).first()
    assert (bad["status"], bad["location"]) == ("Failed", None) and "title" in bad["error"]
    assert (good["status"], good["error"], good["location"]) == ("Completed", None, "/document/1/5/")
    engine.enqueue("Associate Document", source="no range")
    engine.enqueue("Associate Document", source="1", target="1")
    engine.enqueue("Delete Document", 1, 1)
    engine.enqueue("Delete Document")
    assert engine.run_jobs() == {"Completed": 2, "Failed": 2} and engine.list_documents()[1] == 8
    assert engine.list_associations("1").count() > 0


def test_a_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    """Documents and postings are seen together or not at all; the store goes on from what it had."""
    from stemma.plans import store
    from stemma.plans.store import Conflict, Store

    monkeypatch.setattr(store, "LAYERS", 5)
    engine = Engine(spark, str(tmp_path / "store"), SMALL)
    engine.add_documents(documents(spark, [(1, 1, "the first of all texts"), (1, 2, "the second of all texts")]))

    def state():
        ids = sorted((r["doctype"], r["docid"]) for r in engine.table("documents").collect())
        return ids, sorted({(r["doctype"], r["docid"]) for r in engine.table("postings").collect()})

    def lost(*args):
        raise RuntimeError("lost")

    for step in ("_publish", "_rename"):
        with monkeypatch.context() as patch:
            patch.setattr(Store, step, lost)
            for change in (lambda: engine.add_documents(documents(spark, [(1, 3, "a text that comes too late")])), lambda: engine.delete_documents(documents(spark, [(1, 1, "x")]))):
                with pytest.raises(RuntimeError):
                    change()
        assert state() == ([(1, 1), (1, 2)],) * 2
    number, layers = engine.store._manifest()
    with pytest.raises(Conflict):
        engine.store._publish(number, layers)  # the number of another writer
    assert engine.store._manifest() == (number, layers)
    expected = {(1, 1), (1, 2)}
    for i in range(8):
        engine.add_documents(documents(spark, [(2, i % 5 + 1, f"changed again and again: {i}")]))
        expected.add((2, i % 5 + 1))
        if i == 6:
            engine.delete_documents(documents(spark, [(2, 1, "x"), (9, 9, "x")]))
            expected.discard((2, 1))
    assert state() == (sorted(expected),) * 2 and len(engine.store._manifest()[1]) < 8
    last = {r["docid"]: r["text"] for r in engine.table("documents").where("doctype = 2").collect()}
    assert last[3] == f"changed again and again: {7}"
    engine.store.vacuum()
    assert state() == (sorted(expected),) * 2 and len(os.listdir(tmp_path / "store" / "data")) == sum(map(len, engine.store._manifest()[1]))


def test_server(spark, tmp_path):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from stemma.server import server

    engine = Engine(spark, str(tmp_path / "store"), SMALL)
    made = server(engine, 0)
    threading.Thread(target=made.serve_forever, daemon=True).start()

    def ask(method, place, body=None, zipped=False):
        headers = {"Accept-Encoding": "gzip"} if zipped else {}
        try:
            with urlopen(Request(f"http://127.0.0.1:{made.server_port}{place}", body, headers, method=method)) as answer:
                data = answer.read()
                return answer.status, answer.headers["Location"], json.loads(gzip.decompress(data) if zipped else data)
        except HTTPError as why:
            return why.code, why.headers["Location"], json.loads(why.read())

    try:
        assert ask("POST", "/document/1/1/", b"title=one&text=the+labourer+is+worthy+of+his+hire&tag=k")[:2] == (202, "/queue/1/")
        assert ask("POST", "/document/1/2/", b"title=two&text=truly+the+labourer+is+worthy+of+more")[0] == 202
        assert ask("POST", "/document/1/3/", b"title=&text=x")[0] == 202
        assert ask("GET", "/queue/1/")[0] == 202 and ask("GET", "/document/1/1/")[0] == 404
        engine.run_jobs()
        assert ask("GET", "/queue/1/")[:2] == (201, "/document/1/1/") and ask("GET", "/queue/3/")[0] == 400 and ask("GET", "/queue/9/")[0] == 404
        status, _, page = ask("GET", "/document/1/1/", zipped=True)
        assert status == 200 and page["document"]["text"].startswith("the labourer") and page["document"]["meta"] == {"tag": ["k"]}
        status, _, page = ask("GET", "/document/1-2/?order_by=-title&limit=1")
        assert (page["totalRows"], [r["title"] for r in page["rows"]]) == (2, ["two"])
        status, _, page = ask("POST", "/search/1/", b"text=the+labourer+is+worthy")
        assert status == 200 and {r["docid"] for r in page["rows"]} == {1, 2} and page["rows"][0]["fragments"]
        assert ask("POST", "/association/1/1/")[0] == 202
        engine.run_jobs()
        assert ask("GET", "/association/1/")[2]["totalRows"] == 2 and ask("GET", "/index/?limit=2")[2]["totalRows"] == 2
        assert ask("DELETE", "/document/1/2/")[0] == 202
        engine.run_jobs()
        assert ask("GET", "/document/")[2]["totalRows"] == 1 and ask("GET", "/queue/")[2]["totalRows"] == 5
        assert [ask(*x)[0] for x in (("GET", "/nothing/"), ("GET", "/document/x/"), ("GET", "/document/?limit=x"), ("DELETE", "/queue/1/"), ("POST", "/search/", b"text=short"), ("DELETE", "/association/1/"))] == [404, 400, 400, 405, 400, 405]
    finally:
        made.shutdown()
        made.server_close()


def test_event_feed(spark, tmp_path):
    """A feed is followed from where it was left, also over restarts."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from stemma.streaming import sse

    assert list(sse.parsed([b": comment\n", b"id: 7\n", b"data: a\n", b"data:b\r\n", b"\n", b"\n", b"data: c\n", b"\n", b"data: cut"])) == [("7", "a\nb"), ("7", "c")]
    sent = [json.dumps({"title": f"t{i}", "text": f"some text of event {i}", "tag": "x"}) if i != 3 else "{broken" for i in range(8)]

    class Feed(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            for i in range(int(self.headers.get("Last-Event-ID", -1)) + 1, len(sent)):
                self.wfile.write(f"id: {i}\ndata: {sent[i]}\n\n".encode())

        def log_message(self, *args):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{made.server_port}/"
    try:
        store = str(tmp_path / "store")
        assert Engine(spark, store, SMALL).pull_feed("news", 4, url, most=5) == 5
        engine = Engine(spark, store, SMALL)
        assert engine.cursor("news") == "4" and engine.pull_feed("news", 4, url) == 3 and engine.pull_feed("news", 4, url) == 0
        rows = sorted((r["docid"], r["title"], r["meta"]["tag"]) for r in engine.table("documents").collect())
        assert rows == [(k + 1, f"t{i}", ["x"]) for k, i in enumerate([0, 1, 2, 4, 5, 6, 7])]
        assert {r["docid"] for r in engine.search("some text of event 6").collect()} == set(range(1, 8))
        (tmp_path / "feeds.json").write_text(json.dumps([{"name": "late", "doctype": 5, "url": url, "lastEventId": "5"}]))
        assert engine.pull_feeds(str(tmp_path / "feeds.json")) == 2 and engine.cursor("late") == "7"
    finally:
        made.shutdown()
        made.server_close()


def test_rendering(spark, tmp_path):
    from stemma.operators import render as R

    texts = spark.createDataFrame([(1, "the quick brown fox jumps, over it"), (2, "QUICK BROWN FOX! and a lazy dog")], "id long, text string")
    side = A.prepared(texts, "id")
    found = A.associate(side, side, SMALL, exclude_self=True)
    listed = A.associations(found)
    row = listed.select("fragments", R.fragment_json(F.col("fragments")).alias("j")).withColumn("back", R.parse_fragments(F.col("j"))).first()
    assert row["back"] == row["fragments"] and row["j"].startswith("[[")
    docs = documents(spark, [(1, 2, "QUICK BROWN FOX! and a lazy dog")])
    lines = R.association_lines(listed.where("left_id = 1").withColumns({"doctype": F.lit(1), "docid": F.lit(2)}), docs).collect()
    assert "QUICK BROWN FOX" in lines[0]["line"] and lines[0]["line"].startswith("title")
    ranked = spark.createDataFrame([(0, 2, 1, 7, 30, 1.5, 0.25), (0, 1, 3, 9, 40, 1.0, 0.125)], "query_id long, rank int, doctype long, docid long, count long, mean double, score double")
    assert [r["line"].split()[:2] for r in R.match_lines(ranked).collect()] == [["1", "3/9"], ["2", "1/7"]]
    queue = spark.createDataFrame([(1, "Add Document", 2, 3, "", "", "Failed", "why", None)], jobs.SCHEMA)
    assert R.job_lines(queue).first()["line"].split() == ["1", "Failed", "Add", "Document", "2/3", "why"]
    import json

    page = json.loads(R.response(docs.select("doctype", "docid"), 7).first()["value"])
    assert page == {"success": True, "rows": [{"doctype": 1, "docid": 2}], "totalRows": 7}
    R.write_json(docs.drop("meta"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    places = {r["left_id"]: r["places"] for r in A.shared_windows(side, side.where("id = 2"), SMALL).collect()}
    assert places[2] > places[1] > 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from stemma.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("words in a file that are long enough for one window and some more of them")
    store = str(tmp_path / "store")
    assert main([store, "add", str(tmp_path / "in"), "4"]) == 0
    assert main([store, "search", str(tmp_path / "in" / "a.txt")]) == 0
    assert main([store, "list", "4"]) == 0
    assert main([store, "delete", "4", "1"]) == 0 and main([store, "list"]) == 0
    assert capsys.readouterr().out.rstrip().endswith("0")
    assert main([store]) == 2 and main([store, "nothing"]) == 2


@pytest.mark.parametrize("width,shards", [(24, 2), (20, 32), (30, 4), (16, 4)])
def test_index_stats(spark, width, shards):
    from stemma.functions.hashing import window_hashes

    config = replace(SMALL, hash_width=width, shards=shards)
    rng = random.Random(width)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))) + "x" for _ in range(40)]
    expected = {}
    for t in texts:
        hashes = window_hashes(t.upper(), 8, width).tolist()
        for h in hashes:
            row = expected.setdefault(h // config.shard_size, [0, 0, set()])
            row[0] += 1
        for h in set(hashes):
            row = expected[h // config.shard_size]
            row[1] += 1
            row[2].add(h)
    got = {r["shard"]: (r["windows"], r["postings"], r["repeats"], r["hashes"]) for r in I.index_stats(documents(spark, [(1, i + 1, t) for i, t in enumerate(texts)]), config).collect()}
    assert got == {s: (w, p, w - p, len(h)) for s, (w, p, h) in expected.items()}
