import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemma.functions import hashing as H
from stemma.functions import ranges
from stemma.functions.positions import with_positions, with_running_sum
from stemma.functions.text import normalise, pretty
from stemma.plans.config import EngineConfig


def plain_hashes(text, window, width):
    out = []
    for i in range(len(text) - window + 1):
        h = 0
        for c in text[i : i + window]:
            h = (h * 37 + ord(c)) % 2**64
        out.append(((h >> width) ^ h) & (2**width - 1))
    return out


def test_golden_hashes():
    hashes = H.window_hashes("TEXT GOBBLE TEXT", 4, 10)
    assert len(hashes) == 13 and hashes[0] == hashes[12] == 535
    raw = H.window_hashes("Text gobble TEXT".upper(), 4, 32)
    assert raw[0] == 4352653 == raw[12]
    assert H.window_hashes("Text gobble! Text", 4, 10)[0] == 683
    assert (H.whitespace_hash(27, 32), H.whitespace_hash(30, 24)) == (2772848406, 2622887)
    assert (H.theme_id("TEXT"), H.theme_id("THE LABOURER IS WORTHY OF HIS HIRE")) == (19342967934, 146908520846)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é漢😀", max_size=60), st.integers(8, 40), st.integers(12, 63))
def test_hashes_against_plain(text, window, width):
    expected = plain_hashes(text, window, width) if len(text) > window else []
    assert H.window_hashes(text, window, width).tolist() == expected


def test_blank_windows():
    points = H.code_points("A    B   ")
    assert H.blank_windows(points, 3).tolist() == [False, True, True, False, False, False, True]


def test_normalise(spark):
    cases = ["This is some text,!&", "straße ŉ ǆ é", "ﬁ 12 ٣ ² _x", "", None, "ß"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", normalise(F.col("t")).alias("n")).collect()

    def one(c):
        if unicodedata.category(c)[0] != "L" and unicodedata.category(c) != "Nd":
            return " "
        return c.upper() if len(c.upper()) == 1 else c

    for r in rows:
        assert r["n"] == "".join(map(one, r["t"] or "")), r
    a, b = (spark.range(1).select(normalise(F.lit(t)).alias("n")).first()["n"] for t in ("This is some text,!&", "THIS IS SOME TEXT   "))
    assert a == b


def test_pretty(spark):
    got = spark.createDataFrame([("a\nb",), ("x" * 60,)], "t string").select(pretty(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == ["a b", "x" * 57 + "..."]


@pytest.mark.parametrize("text", ["", "1", "1-2", "2-1", "1:2", "1-2:3:9", "1-3:7-6:9", "1-10:2-3"])
def test_valid_ranges(text):
    assert ranges.valid(text)


@pytest.mark.parametrize("text", ["a", "1-", "-1", "1:", "1--2", " 1"])
def test_invalid_ranges(text):
    assert not ranges.valid(text)
    with pytest.raises(ValueError):
        ranges.intervals(text)


def test_membership(spark):
    text = "1-3:7-6:9"
    assert [v for v in range(1, 10) if ranges.contains(text, v)] == [1, 2, 3, 6, 7, 9]
    assert ranges.contains("1-10:2-3", 5) and ranges.contains("", 4)
    got = spark.range(1, 10).withColumnRenamed("id", "doctype").where(ranges.predicate(text)).collect()
    assert sorted(r["doctype"] for r in got) == [1, 2, 3, 6, 7, 9]


def test_config():
    for wrong in ({"window": 7}, {"hash_width": 65}, {"shards": 3}, {"limit": -1}, {"min_hits": 0}):
        with pytest.raises(ValueError):
            EngineConfig(**wrong)
    assert EngineConfig(shards=4).shard_size == 2**22


def test_positions(spark):
    rng = np.random.default_rng(3)
    rows = [(("a", "b")[int(x > 0.7)], int(v)) for x, v in zip(rng.random(300), rng.integers(0, 50, 300))]
    df = spark.createDataFrame(rows, "g string, v long").withColumn("b", F.floor(F.col("v") / 5))
    for r in with_positions(df, ["g"], "b", ["v"], "at", "n").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("x"), F.max("n").alias("n")).collect():
        own = sorted(v for g, v in rows if g == r["g"])
        assert [(x["at"], x["v"]) for x in r["x"]] == list(enumerate(own)) and r["n"] == len(own)
    sums = with_running_sum(df, [], "b", ["v", "g"], F.col("v"), "before", "all").collect()
    assert {r["all"] for r in sums} == {sum(v for _, v in rows)}
    assert sorted(r["before"] for r in sums)[0] == 0
