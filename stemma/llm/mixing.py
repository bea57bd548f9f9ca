"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions.positions import with_running_sum
from stemma.llm.texts import n_words
from stemma.shared import materialise

WEIGHTS = (5, 2, 1)
CAP = 3
#: Newton ends when every source's tokens are this near its target, as a part of it.
NEAR = 1e-9
MOST_STEPS = 60
#: Turns in which the rest of a target is filled, each by smaller documents.
TURNS = 4
#: Buckets in which the waiting documents of a source are ordered: least number in a factor e of their order, and rows of one, about.
LEAST_BUCKETS, BUCKET_ROWS = 1024, 100_000


def _exact_sum(value: Column) -> Column:
    """A sum of doubles, each taken to nine places, that does not depend on their order."""
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """Target tokens of each source, from rows (stratum, source, source_size).

    Sources in code point order, null last, take the weights in turn and share
    ``share`` of all sizes; a target stops at ``cap`` times its source's size and
    the excess is shared again by weight. The fixed point is one water level:
    least(cap * size, level * weight), found by one pass over the sources in the
    order of the level at which each one fills. Works on one row per source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w.cast("double")).withColumn("fills_at", cap * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("fills_at", "stratum")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap * F.col("source_size")).over(earlier), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(later))
    # The first source that does not fill fixes the level for all after it.
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "stratum", "level"))).over(whole)["level"]
    return rows.withColumn("target", F.coalesce(F.least(cap * F.col("source_size").cast("double"), level * F.col("weight")), cap * F.col("source_size").cast("double"))).select("stratum", "source_size", "target")


def _coefficient(size: Column, mean: int) -> Column:
    """How strongly the multiplier of its source tilts a document of ``size`` tokens."""
    return size / (size + mean)


def _rate(size: Column, multiplier: Column, mean: int, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(multiplier * _coefficient(size, mean), F.lit(50.0))))


def multipliers(counts: DataFrame, goals: DataFrame, mean: int, cap: int = CAP) -> DataFrame:
    """Solve the convex dual: one multiplier per source, by distributed Newton steps.

    Rates w minimise the sum over documents of (size + mean) * (w log w - w) under
    w <= cap and one constraint per source, sum of size * w = target; so w is
    exp(multiplier * size / (size + mean)), cut at the cap. The dual is smooth and
    convex in each multiplier; a step sums gradient and curvature over the counts
    of documents by (source, size) and is halved into the bracket where it leaves
    it. A source whose target is cap times its size needs no multiplier: all its
    rates are the cap. A target of zero gives rates of zero. All sums are exact, so
    reruns agree to the last bit, however rows are spread over tasks.
    """
    size, low, high, at = (F.col(c) for c in ("size", "low", "high", "multiplier"))
    tokens = F.col("size") * F.col("documents")
    slope = counts.groupBy("stratum").agg((_exact_sum(tokens * _coefficient(size, mean)) / F.sum(tokens)).alias("slope"))
    free = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    ratio = F.log(F.col("target") / F.col("source_size"))
    state = goals.where(free).join(slope, "stratum").select(
        "stratum", "target",
        F.least(ratio * (mean + 1), F.lit(0.0)).alias("low"),
        F.lit(math.log(cap) * (mean + 1)).alias("high"),
        (ratio / F.col("slope")).alias("multiplier"),
    )
    for step in range(MOST_STEPS):
        rate = _rate(size, at, mean, cap)
        sums = counts.join(state, "stratum").groupBy("stratum", "target", "low", "high", "multiplier").agg(
            _exact_sum(tokens * rate).alias("got"),
            _exact_sum(F.when(rate < cap, tokens * rate * _coefficient(size, mean)).otherwise(0.0)).alias("curve"),
        )
        over = F.col("got") - F.col("target")
        bracketed = sums.withColumn("low", F.when(over <= 0, at).otherwise(low)).withColumn("high", F.when(over >= 0, at).otherwise(high))
        newton = F.when(F.col("curve") > 0, at - over / F.col("curve"))
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        near = F.abs(over) <= NEAR * F.col("target")
        moved = F.when(near, at).when(inside, newton).otherwise((low + high) / 2)
        state = materialise(bracketed.select("stratum", "target", "low", "high", moved.alias("multiplier"), near.alias("near")), f"newton-{step}")
        if state.where(~F.col("near")).isEmpty():
            break
        state = state.drop("near")
    return goals.join(state.select("stratum", "multiplier"), "stratum", "left")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = CAP, seed: int = 5) -> DataFrame:
    """How many copies of each document bring every source to its target tokens.

    Returns doc_id, source, size (words), source_size, target, rate, copies. Rates
    come from the convex dual (``multipliers``); their whole parts are taken, and
    the rest of the target is filled by documents in the order of u / fraction
    (sequential Poisson sampling; u from the digest of seed and doc_id) while their
    tokens fit, then by smaller documents of the same order in what is left, for
    ``TURNS`` turns in all. Copies are the rate rounded down or up, so never above ``cap``.

    Null text: size 0. A document of size 0 has rate 1 and one copy, and takes
    nothing. Null source: a source of its own, last in order. Repeated rows and
    repeated ids are separate documents of equal rate. Empty table: empty result.
    Other columns are ignored, whatever their names. Running sums go by buckets, so
    no source is ordered in one task; texts are read once and never moved. A bucket
    spans a fixed part of a factor e in u / fraction; as u is even from 0 to 1, each
    holds at most about that part of its source, whatever the fractions are.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    stratum = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = materialise(docs.select("doc_id", "source", stratum.alias("stratum"), n_words(F.col("text")).alias("size"), u.alias("u")), "sizes")
    counts = materialise(rows.groupBy("stratum", "source", "size").agg(F.count(F.lit(1)).alias("documents")), "size-counts")
    sizes = counts.groupBy("stratum", "source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    n, all_words = counts.agg(F.sum("documents"), F.sum(F.col("size") * F.col("documents"))).first()
    mean = max(1, round((all_words or 0) / max(n or 1, 1)))
    goals = materialise(targets(sizes, weights, share, cap), "targets")
    solved = multipliers(counts.where("size > 0"), goals, mean, cap)

    full = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("multiplier").isNull(), full).otherwise(_rate(F.col("size"), F.col("multiplier"), mean, cap))
    rated = rows.join(solved, "stratum").withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    rest = F.col("rate") - F.col("whole")
    turn = F.when(rest > 1e-9, F.col("u") / rest)
    buckets = max(LEAST_BUCKETS, (n or 0) // BUCKET_ROWS)
    rated = rated.withColumn("turn", turn).withColumn("bucket", F.floor(buckets * F.log("turn")))
    rated = materialise(rated, "rates")

    order = ["turn", "doc_id", "size"]
    columns = ["doc_id", "source", "size", "source_size", "target", "rate"]
    left = lambda rows: rows.select(*columns, F.col("whole").alias("copies"))
    room = rated.groupBy("stratum").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("room"))
    made = left(rated.where(F.col("turn").isNull()))
    waiting = rated.where(F.col("turn").isNotNull()).join(room, "stratum")
    for k in range(TURNS):
        made = made.unionByName(left(waiting.where(F.col("size") > F.col("room"))))
        summed = with_running_sum(waiting.where(F.col("size") <= F.col("room")), ["stratum"], "bucket", order, F.col("size"), "before", "of")
        judged = materialise(summed.withColumn("more", F.col("before") + F.col("size") <= F.col("room")).drop("before", "of"), f"turn-{k}")
        taken = judged.where("more")
        made = made.unionByName(taken.select(*columns, (F.col("whole") + 1).alias("copies")))
        filled = taken.groupBy("stratum").agg(F.sum("size").alias("filled"))
        waiting = judged.where(~F.col("more")).drop("more").join(filled, "stratum", "left")
        waiting = waiting.withColumn("room", F.col("room") - F.coalesce("filled", F.lit(0))).drop("filled")
    return made.unionByName(left(waiting))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each repeated by its number of copies.

    Keeps all columns. Rows that agree in id, source and size all get the rounded
    mean of their copies.
    """
    plan = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.round(F.avg("copies")).cast("int").alias("copies"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    whole = whole.withColumn("size", n_words(F.col("row.text")))
    plan = plan.where("copies > 0").select(F.col("doc_id").alias("plan_id"), F.col("source").alias("plan_source"), F.col("size").alias("plan_size"), "copies")
    on = F.col("row.doc_id").eqNullSafe(F.col("plan_id")) & F.col("row.source").eqNullSafe(F.col("plan_source")) & (F.col("size") == F.col("plan_size"))
    return whole.join(plan, on).select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: how many words each gives to its source's target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", F.col("copies").cast("int").alias("copies"))
