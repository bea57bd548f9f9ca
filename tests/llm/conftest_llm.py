import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use for themselves.
CLASHING = ["bucket", "size", "turn", "key", "row", "lost", "hi", "stratum", "at", "n", "copies", "rank", "fingerprint", "component_id", "n_words", "rule", "kept", "words", "plan_id", "stay_id", "copy", "__made", "lost_id", "text_crc32", "rate", "target"]


def documents(spark, texts, sources=None, langs=None, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["a"] * len(texts) if sources is None else sources
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in zip(ids, texts, langs, sources)]
    return spark.createDataFrame(rows, COLUMNS)


def with_clashes(docs):
    from pyspark.sql import functions as F

    for c in set(CLASHING) - set(docs.columns):
        docs = docs.withColumn(c, F.lit("own"))
    return docs


@pytest.fixture(scope="session")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]


#: Null, empty, blank, separators that are no white space here, ties, a very long text.
EDGES = [None, "", " \n\t\x0b\x0c\r ", "a b\x1cc", "One\nOne\nOne", "One\nOne\nOne", "ÀÉ ß 漢字 😀 #*", "word " * 30_000, "x" * 20_000, "\n\n", None]
EDGE_IDS = [0, 1, 2, 3, 4, 4, None, 7, 8, 9, None]
