"""Chat formatting: every participant's perspective of a dialogue, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turns of one part of a conversation at most; a part is one output row for each perspective.
PART = 1024
NO_TURN = (1 << 63) - 1


def _escaped(value: Column) -> Column:
    """Text in which no marker can begin."""
    return F.replace(F.coalesce(value, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, part: int = PART, common: tuple[str, ...] = ("system",)) -> DataFrame:
    """Render each conversation once for every participant.

    ``turns`` has conv_id, turn, role (the speaker's name) and text. In the
    perspective of a speaker their turns are those of the assistant, all others
    those of users with a name; turns of a role in ``common`` are the same for all
    and give no perspective. Returns conv_id, perspective, part, n_turns, text and
    spans, an array of (start, end) in code points: the assistant's words and end
    markers, on which to learn.

    Blocks of ``part`` turn numbers are ordered by themselves and cut into parts of at
    most ``part`` turns, so a conversation of any length is split over tasks and its
    rows are bounded, also where a turn number repeats or is null. Parts are counted
    from 0; joined in order they are the whole dialogue. The texts are shuffled once,
    by conversation and block, before they multiply.

    Null role: the name ``unknown``. Null text: an empty turn. Null turn: after all
    others, in a block of its own. Equal turns follow in the order of role and text;
    repeated rows are separate turns. Null conv_id: one more conversation. A
    conversation of common roles only gives no row, an empty table an empty result.
    Markers inside texts and names are broken up by a space. Other columns are
    ignored, whatever their names.
    """
    turn = F.col("turn").cast("long")
    rows = turns.select(
        F.col("conv_id"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"),
        F.col("conv_id").isNull().alias("keyless"),
        F.coalesce(F.floor(turn / part), F.lit(NO_TURN)).alias("block"),
        F.coalesce(turn, F.lit(NO_TURN)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        _escaped(F.col("text")).alias("text"),
    )
    keys = ["key", "keyless"]
    nth = F.row_number().over(Window.partitionBy(*keys, "block").orderBy("turn", "role", "text")) - 1
    cut = rows.withColumn("nth", nth).withColumn("cut", F.expr(f"nth div {part}"))
    collected = cut.groupBy(*keys, "block", "cut").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    blocks = rows.groupBy(*keys, "block").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    blocks = blocks.withColumn("first", F.sum("parts").over(Window.partitionBy(*keys).orderBy("block")) - F.col("parts"))
    speakers = rows.where(~F.col("role").isin(*common)).select(*keys, F.col("role").alias("perspective")).distinct()
    joined = collected.join(blocks.join(speakers, keys), [*keys, "block"]).withColumn("part", F.col("first") + F.col("cut"))

    def piece(t: Column) -> Column:
        own, shared = t["role"] == F.col("perspective"), t["role"].isin(*common)
        user = F.concat(F.lit("user name="), _escaped(t["role"]))
        head = F.concat(F.lit("<|im_start|>"), F.when(own, F.lit("assistant")).when(shared, _escaped(t["role"])).otherwise(user), F.lit("\n"))
        return F.struct(head.alias("head"), F.concat(t["text"], F.lit("<|im_end|>")).alias("body"), own.alias("own"))

    def laid(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    pieces = F.transform("turns", piece)
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return joined.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").alias("n_turns"),
        text.alias("text"),
        F.aggregate(pieces, none, laid)["spans"].alias("spans"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from the perspective of each participant; spans as ``start-end`` lists."""
    rotated = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotated.select("conv_id", "perspective", "part", "n_turns", "text", spans.alias("mask"))


OP3_SQL = """
WITH r AS (
  SELECT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(turn // 1024, 9223372036854775807) AS block,
         coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), b AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn, role, text) - 1) // 1024 AS cut FROM r
), c AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY block, cut) - 1 AS part FROM b
), s AS (
  SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'
), p AS (
  SELECT c.*, s.perspective, c.role = s.perspective AS own,
         '<|im_start|>' || CASE WHEN c.role = s.perspective THEN 'assistant' WHEN c.role = 'system' THEN 'system'
                           ELSE 'user name=' || replace(c.role, '<|', '< |') END || chr(10) AS head,
         c.text || '<|im_end|>' AS body
  FROM c JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, row_number() OVER w AS nth,
         sum(length(head) + length(body) + 1) OVER (w ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS start_at
  FROM p WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text)
)
SELECT conv_id, perspective, part, count(*)::INTEGER AS n_turns, string_agg(head || body || chr(10), '' ORDER BY nth) AS text,
       coalesce(string_agg(start_at::BIGINT || '-' || (start_at + length(body))::BIGINT, ',' ORDER BY nth) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
