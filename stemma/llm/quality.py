"""Quality rules: document statistics and a learned decision list, in built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.texts import SPACE
from stemma.shared import materialise

#: Words of a window; a power of two.
WINDOW = 8
#: Labelled documents that a fit reads at most.
SAMPLE = 20_000
#: A rule must be right so often on labelled documents that it was not grown from, plus one of each kind.
PRECISION = 0.9
MOST_RULES = 8
MOST_CONDITIONS = 4
#: Conditions of at least this part of the best gain count as equally good.
NEARLY = 0.97
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once per row wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(grams: Column) -> Column:
    """Words inside windows whose digest is found twice or more, from all windows' digests.

    Sorted by digest, equal windows are neighbours; their starts, sorted again, are
    swept once, each adding what it covers beyond the last.
    """

    def neighbours(rows: Column) -> Column:
        same = F.filter(rows, lambda x, j: (x["h"] == F.get(rows, j - 1)["h"]) | (x["h"] == F.get(rows, j + 1)["h"]))
        return F.filter(same, lambda x: x.isNotNull())

    def swept(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct((acc["total"] + i + WINDOW - F.greatest(acc["end"], i)).alias("total"), (i + WINDOW).alias("end"))
        return F.aggregate(starts, zero, step)["total"]

    rows = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return swept(F.sort_array(F.transform(_let(rows, neighbours), lambda x: x["i"])))


def _window_digests(words: Column) -> Column:
    """Digests of all windows of ``WINDOW`` words, each of two digests of half as many."""
    out, size = F.transform(words, lambda w: F.xxhash64(w)), 1
    while size < WINDOW:
        step = size

        def joined(a: Column) -> Column:
            later = F.slice(a, F.lit(step + 1), F.greatest(F.size(a) - step, F.lit(0)))
            return F.zip_with(a, later, lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))

        out, size = _let(out, joined), 2 * size
    return F.filter(out, lambda h: h.isNotNull())


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``STATISTICS`` (long) and ``base_failed`` to every row.

    Each row is judged alone, so nothing is shuffled. A null text counts as empty.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(value, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def repeats(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(_repeated_words(grams))

    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), _let(_window_digests(w), repeats).alias("repeated"), F.size(F.array_distinct(w)).alias("distinct"), F.length(F.array_join(w, "")).alias("chars")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeated")))
    # The row number makes the optimiser evaluate this once per row: it neither
    # pushes later filters below it nor repeats it for each use.
    made = F.struct(
        of_words.alias("words"), of_lines.alias("lines"),
        F.regexp_count(value, F.lit("[#*$%&|<>]")).alias("symbols"),
        F.monotonically_increasing_id().alias("row"),
    )
    fields = {
        "n_words": "words.n", "word_chars": "words.chars", "n_symbols": "symbols", "n_dup_lines": "lines.repeated",
        "n_repeat_words": "words.repeated", "n_lines": "lines.n", "n_distinct_words": "words.distinct",
    }
    rows = docs.withColumn("__made", made).withColumns({k: F.col(f"__made.{v}").cast("long") for k, v in fields.items()}).drop("__made")
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def features(row: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """What conditions look at: doubles made of the statistics of documents with words."""
    words, lines = (F.greatest(row(c), F.lit(1)).cast("double") for c in ("n_words", "n_lines"))
    return {
        "words": row("n_words").cast("double"),
        "mean word": row("word_chars") / words,
        "symbols a word": row("n_symbols") / words,
        "repeated lines": row("n_dup_lines") / lines,
        "repeated words": row("n_repeat_words") / words,
        "distinct words": row("n_distinct_words") / words,
    }


@dataclass
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects, none keeps."""

    rules: list[list[Condition]] = field(default_factory=list)

    def column(self, row: Callable[[str], Column] = F.col) -> Column:
        """The rule that rejects a row with statistics, as text; null for none."""
        of, out = features(row), F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(_all(rule, of), F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


def _all(rule: list[Condition], of: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(of)
    return out


def _thresholds(rows: DataFrame) -> tuple[dict[str, list[float]], dict[str, list[float]]]:
    """Halfway between neighbours among the quantiles of either class, and how wide each gap is as a part of all."""
    steps = [i / 20 for i in range(21)]
    names = list(features())
    found = rows.groupBy("bad").agg(*(F.percentile_approx(F.col(f"`{n}`"), steps, 1000).alias(n) for n in names)).collect()
    cuts, gaps = {}, {}
    for n in names:
        seen = sorted({v for r in found for v in r[n] or []})
        cuts[n] = [(a + b) / 2 for a, b in zip(seen, seen[1:])]
        gaps[n] = [(b - a) / (seen[-1] - seen[0]) for a, b in zip(seen, seen[1:])]
    return cuts, gaps


def _gain(p: int, n: int, all_p: int, all_n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n))) if p else 0.0


def fit_decision_list(rows: DataFrame, precision: float = PRECISION, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS) -> DecisionList:
    """Sequential covering over rows with statistics and a boolean ``bad``.

    A rule grows on two thirds of the rows that no rule covers yet, condition by
    condition by information gain (among nearly equal ones by the widest gap, which
    clean documents unseen so far are least likely to cross), until it covers no
    good row; it is pruned on the
    other third by dropping last conditions while (p - n) / (p + n) does not fall;
    it is kept if it is right often enough on that third. Each step is one
    aggregation into counts by feature, bin and class. Without rows of both kinds
    the list is empty and keeps all.
    """
    names = list(features())
    thirds = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(3)) == 0
    rows = materialise(rows.select(F.col("bad"), thirds.alias("held"), *(v.alias(n) for n, v in features().items())), "labelled")
    value = {n: F.col(f"`{n}`") for n in names}
    below = lambda v: lambda cut: cut < v
    made = DecisionList()
    uncovered = F.lit(True)
    while len(made.rules) < most_rules:
        rule: list[Condition] = []
        left = rows.where(uncovered)
        cuts, gaps = _thresholds(left)
        bins = F.array(*(F.size(F.filter(F.array(*map(F.lit, cuts[n])).cast("array<double>"), below(value[n]))) for n in names))
        left = materialise(left.withColumn("bins", bins), "labelled-bins")
        while len(rule) < most_conditions:
            counts = left.where(~F.col("held") & _all(rule, value)).select("bad", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin", "bad").count().collect()
            table = {(r["feature"], r["bin"], r["bad"]): r["count"] for r in counts}
            all_p, all_n = (sum(v for k, v in table.items() if k[0] == 0 and k[2] == bad) for bad in (True, False))
            if not all_p or not all_n:
                break
            options = []
            for f, name in enumerate(names):
                p = n = 0
                for k, cut in enumerate(cuts[name]):  # rows of bins 0 to k are at or under cut k
                    p, n = p + table.get((f, k, True), 0), n + table.get((f, k, False), 0)
                    for above, a, b in ((False, p, n), (True, all_p - p, all_n - n)):
                        options.append((_gain(a, b, all_p, all_n), gaps[name][k], Condition(name, above, cut)))
            most = max((o[0] for o in options), default=0.0)
            if most <= 0:
                break
            rule.append(max((o for o in options if o[0] >= NEARLY * most), key=lambda o: (o[1], o[0]))[2])
        if not rule:
            break
        held = left.where(F.col("held")).agg(*(F.count(F.when(_all(rule[: i + 1], value) & (F.col("bad") == bad), 1)) for i in range(len(rule)) for bad in (True, False))).first()
        worth = [((held[2 * i] - held[2 * i + 1]) / max(1, held[2 * i] + held[2 * i + 1]), held[2 * i], held[2 * i + 1]) for i in range(len(rule))]
        at = max(range(len(rule)), key=lambda i: (worth[i][0], worth[i][1], -i))
        p, n = worth[at][1:]
        if (p + 1) / (p + n + 2) < precision and not (n == 0 and p >= 2):
            break
        made.rules.append(rule[: at + 1])
        uncovered = uncovered & ~_all(rule[: at + 1], value)
    return made


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics of labelled documents that pass the base rules, with ``bad``.

    Of all labelled ids the ``sample`` lowest by digest are taken, so the ids sent
    to all executors are bounded. An id with several labels is bad if any says so.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    chosen = materialise(chosen.orderBy(F.xxhash64("doc_id", F.lit(44)), "doc_id").limit(sample), "labelled-ids")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return with_statistics(found).where(~F.col("base_failed"))


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> DecisionList:
    return fit_decision_list(labelled_sample(docs, labels, sample), **options)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Add statistics, base_failed, the rejecting ``rule`` (null: none) and ``kept``.

    Null or empty text: no words, so the base rule rejects it. Null or repeated ids
    and repeated rows: each row is judged by its own text. A very long text is judged
    whole, its words and windows as arrays of its one row. Empty table: empty result.
    Columns that have the names of the added ones are replaced by them; all others
    pass unchanged.
    """
    rows = with_statistics(docs).withColumn("rule", rules.column())
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the base rules and the learned list keep, all columns unchanged."""
    rules = learn_quality(docs, labels, **options)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    judged = judge(rows.withColumn("text", F.col("row.text")), rules)
    return judged.where("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_distinct_words", "rule")
