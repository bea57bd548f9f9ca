"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.shared import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs to (node, component), the smallest node reachable.

    Every linked node other than the smallest of its component gets one row, so an
    empty result means no links. Neither step gathers a node's neighbours: their
    minimum is an aggregate with map-side combine that is joined back, so a node
    with a large part of all links is no single task. Each round is written to the
    shared folder. Null ends and loops are ignored; repeated links count once.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialise(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return edges.select(a.alias("node"), b.alias("component"))
        before = state
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("least"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        small = small.select(b.alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        edges = materialise(small.where(a != b).distinct(), "stars")
