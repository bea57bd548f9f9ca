"""Each stage against a brute-force version on its own input."""

import random
from collections import Counter

import sentencepiece
import pytest
from conftest_llm import documents, with_clashes

import corpus_pipeline
from stemma.llm import mixing, pieces, quality
from stemma.shared import materialise
from test_lines_chunks import plain_dedup
from test_native import plain_statistics
from test_pairs import plain_components, plain_fingerprint


def test_stages(spark, words, tmp_path):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 200))) for _ in range(120)]
    foot = "a line that stands below many of the documents"
    texts = [f"{t}\n{foot}" if i % 3 == 0 else t for i, t in enumerate(clean)]
    texts += [clean[i] for i in range(0, 40, 4)] * 2  # exact copies
    texts += ["", " \n", "too short", " ".join(["again and again and"] * 30)]
    junk = [" ".join(w + "###" for w in clean[i].split()) for i in range(60)]
    docs = documents(spark, texts + junk, [("a", "b", "c")[i % 3] for i in range(len(texts + junk))])
    labels = [(i, int(i < len(texts)), 0) for i in range(0, len(texts + junk), 2)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    rows, frame = [], docs
    for name, stage in corpus_pipeline.STAGES:
        frame = materialise(stage(spark, frame, str(tmp_path)), "stage")
        rows.append(frame.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == docs.columns
    first, lined, apart, mixed, encoded = rows

    rules = quality.learn_quality(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).collect()}
    assert sorted(r["doc_id"] for r in first) == sorted(i for i, k in verdicts.items() if k)
    for i, t in enumerate(texts + junk):
        if plain_statistics(t)[-1]:
            assert not verdicts[i]
    assert all(verdicts[i] for i in range(140)) and not any(verdicts[i] for i in range(len(texts), len(texts + junk)))

    expected = {i: text for i, _, _, text in plain_dedup([(r["doc_id"], r["text"]) for r in first])}
    assert {r["doc_id"]: r["text"] for r in lined} == expected and len(lined) == len(first)
    assert all(r["n_chars"] == len(r["text"]) for r in lined)

    ids = [r["doc_id"] for r in lined]
    roots = plain_components(ids, [plain_fingerprint(r["text"]) for r in lined])
    assert sorted(r["doc_id"] for r in apart) == sorted(set(roots))
    assert {r["doc_id"]: r["text"] for r in apart} == {i: expected[i] for i in set(roots)}

    before = materialise(documents(spark, [r["text"] for r in apart], [r["source"] for r in apart], ids=[r["doc_id"] for r in apart]), "apart")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({i: c for i, c in copies.items() if c})

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded) == Counter((r["doc_id"], tuple(library.encode(r["text"]))) for r in mixed)
    assert all(r["exact"] for r in encoded)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r["doc_id"] for r in encoded)


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_edges_of_the_pipeline(spark, words, tmp_path, kind):
    """Nulls in any column, repeated rows, emptied texts, clashing names; an empty table."""
    rng = random.Random(2)
    lines = ["\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(4)) for _ in range(12)]
    texts = [*lines, lines[0], "\n".join(x.split("\n")[0] for x in lines[1:5]), None, "", "few words", lines[11], lines[11], lines[10]]
    ids = [*range(12), 12, 13, 14, 15, 16, 17, 17, None]
    sources = [None if i % 3 == 0 else "a" for i in range(len(texts))]
    docs = with_clashes(documents(spark, texts, sources, langs=[None] * len(texts), ids=ids))
    if kind == "none":
        docs = docs.where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, rows = docs, []
    for name, stage in corpus_pipeline.STAGES:
        frame = materialise(stage(spark, frame, str(tmp_path)), "edge")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == docs.columns
        rows.append(frame.collect())
    first, lined, apart, mixed, encoded = rows
    if kind == "none":
        assert rows == [[]] * 5
        return
    assert sorted((r["doc_id"] for r in first), key=str) == sorted((i for i, t in zip(ids, texts) if len((t or "").split()) >= 20), key=str)
    emptied = {r["doc_id"] for r in lined if not r["text"].strip()}
    assert emptied == {12, 13, 17} and [r["text"] for r in lined if r["doc_id"] is None] == [lines[10]]
    assert {r["doc_id"] for r in apart} == {*range(12), 12}  # the row without an id is a copy of document 10
    assert {r["doc_id"]: len(r["ids"]) for r in encoded}[12] == 0 and len(encoded) == len(mixed)
