"""URL filters: host and path rules, and boosted trees on lexical features for the rest.

Only built-in functions run over the tables. The driver gets the features of a
bounded sample of labelled addresses, on which it boosts the trees; they come back
as conditional expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.shared import materialise

#: Verdict, host, start of the path; a rule fits its host and all subdomains.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled addresses that trees are fitted on at most: thirteen numbers each on the driver.
SAMPLE = 20_000
TREES = 12
DEPTH = 3
RATE = 0.3
BINS = 16
#: Rows of prior that an address suffix's rate is smoothed with, and the ridge of leaf values.
SMOOTH = 10.0
RIDGE = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Add host and path: the host in lower case after the first ``://``; both empty without one."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as text, and its verdict; both null for none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(host + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _entropy(value: Column) -> Column:
    """Bits a character, from how often each different character is found."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    shares = F.transform(F.array_distinct(F.split(value, "")), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n)
    return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def _lexical() -> dict[str, Column]:
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda value, pattern: F.length(F.regexp_replace(value, f"[^{pattern}]", ""))
    parameters = F.when(F.contains(url, F.lit("?")), 1 + count(url, "&")).otherwise(0)
    return {
        "length": F.length(url),
        "host length": F.length("host"),
        "path length": F.length("path"),
        "depth": count(F.col("path"), "/"),
        "host labels": count(F.col("host"), "."),
        "digit ratio": count(url, "0-9") / n,
        "hyphen ratio": count(url, "-") / n,
        "entropy": _entropy(url),
        "parameters": parameters,
    }


#: Suffixes whose share of blocked addresses is a statistic: column, pattern, group.
SUFFIXES = {
    "top suffix": ("host", r"[^.]*$", 0),
    "site suffix": ("host", r"[^.]*\.?[^.]*$", 0),
    "first folder": ("path", r"^/?([^/]*)/", 1),
    "file suffix": ("path", r"\.[^./]*$", 0),
}


@dataclass
class Node:
    """A split on ``feature`` at bin ``cut`` (rows of bins up to it go left), or a leaf's value."""

    value: float = 0.0
    feature: int = -1
    cut: int = -1
    left: Node | None = None
    right: Node | None = None

    def column(self, bins: str = "bins") -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(F.get(bins, F.lit(self.feature)) <= self.cut, self.left.column(bins)).otherwise(self.right.column(bins))

    def of(self, bins: list[int]) -> float:
        if self.feature < 0:
            return self.value
        return (self.left if bins[self.feature] <= self.cut else self.right).of(bins)


@dataclass
class UrlModel:
    """A boosted model: cuts of every feature, the suffix statistics' table, trees."""

    names: list[str]
    cuts: list[list[float]]
    suffixes: DataFrame
    prior: float
    base: float
    trees: list[Node] = field(default_factory=list)

    def score(self, bins: str = "bins") -> Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + t.column(bins)
        return 1 / (1 + F.exp(-total))


def _with_suffix_rates(rows: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    """Add the rate of each suffix, drawn towards the prior so that rare ones say little."""
    for name, (column, pattern, group) in SUFFIXES.items():
        table = suffixes.where(F.col("kind") == name).select(F.col("suffix").alias("__suffix"), F.col("n").alias("__n"), F.col("blocked").alias("__blocked"))
        rows = rows.withColumn("__value", F.regexp_extract(column, pattern, group)).join(table, F.col("__value") == F.col("__suffix"), "left")
        n, blocked = F.coalesce("__n", F.lit(0)), F.coalesce("__blocked", F.lit(0))
        rows = rows.withColumn(name, (blocked + SMOOTH * prior) / (n + SMOOTH)).drop("__value", "__suffix", "__n", "__blocked")
    return rows


def _binned(rows: DataFrame, names: list[str], cuts: list[list[float]]) -> Column:
    below = lambda v: lambda cut: cut < v
    return F.array(*(F.size(F.filter(F.array(*map(F.lit, c)).cast("array<double>"), below(F.col(f"`{n}`")))) for n, c in zip(names, cuts)))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, sample: int = SAMPLE) -> UrlModel:
    """Boost logistic trees on rows with url, host, path and a boolean ``blocked``.

    The suffix statistics count all labelled rows. Cuts and trees are fitted on at
    most ``sample`` of them, those lowest by digest of the address. Sums are rounded
    before they are compared, so reruns agree.
    """
    y = F.col("blocked").cast("int")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract(*v).alias("suffix")) for k, v in SUFFIXES.items()))
    counted = labelled.select(y.alias("y"), F.inline(kinds)).groupBy("kind", "suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("blocked"))
    suffixes = materialise(counted, "suffixes")
    n, blocked = suffixes.where(F.col("kind") == "top suffix").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    prior = (blocked + 0.5) / (n + 1)
    names = [*_lexical(), *SUFFIXES]
    model = UrlModel(names, [[] for _ in names], suffixes, prior, round(math.log(prior / (1 - prior)), 9))
    if not blocked or blocked == n:
        model.base = -20.0 if not blocked else 20.0
        return model
    chosen = labelled.orderBy(F.xxhash64("url", F.lit(2)), "url", "blocked").limit(sample)
    rows = chosen.select("url", *(v.cast("double").alias(k) for k, v in _lexical().items()), "host", "path", y.alias("y"))
    rows = _with_suffix_rates(rows, suffixes, prior).select("y", *(F.col(f"`{k}`") for k in names)).collect()
    made = np.array(sorted(map(tuple, rows)), float).reshape(-1, 1 + len(names))
    y, values = made[:, 0], made[:, 1:]
    steps = [i / BINS for i in range(1, BINS)]
    model.cuts = [sorted(set(np.quantile(column, steps, method="inverted_cdf").tolist())) for column in values.T]
    bins = np.stack([np.searchsorted(cuts, column) for cuts, column in zip(model.cuts, values.T)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree, value = _grown(bins, y - p, p * (1 - p), depth, rate)
        model.trees.append(tree)
        margin += value
    return model


def _grown(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> tuple[Node, np.ndarray]:
    """A tree on gradients and curvatures, and its value for each row."""
    node, value = Node(round(rate * g.sum() / (h.sum() + RIDGE), 6)), np.empty(len(g))
    value[:] = node.value
    best = (1e-6, -1, -1)
    for f in range(bins.shape[1]) if depth else ():
        a, c = (np.cumsum(np.bincount(bins[:, f], weights=w)) for w in (g, h))
        gains = np.round(a * a / (c + RIDGE) + (a[-1] - a) ** 2 / (c[-1] - c + RIDGE) - a[-1] ** 2 / (c[-1] + RIDGE), 6)[:-1]
        if len(gains) and gains.max() > best[0]:
            best = (gains.max(), f, int(gains.argmax()))
    if best[1] >= 0:
        node.feature, node.cut = best[1:]
        low = bins[:, node.feature] <= node.cut
        node.left, value[low] = _grown(bins[low], g[low], h[low], depth - 1, rate)
        node.right, value[~low] = _grown(bins[~low], g[~low], h[~low], depth - 1, rate)
    return node, value


def judge(pages: DataFrame, rules=RULES, trees: int = TREES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score) for all pages.

    The longest rule that fits gives the verdict; the addresses that a rule fits
    are the labelled ones, on which the trees learn to judge all others: block at a
    score of one half. Without labelled addresses of both kinds the others get the
    kind that was seen, else allow.

    Null url, or one without ``://``: host and path are empty, and the trees judge
    it. A very long url is judged whole; its row is never moved but for its suffixes.
    Null page_id and repeated rows: each row is judged. Empty table: empty
    result. Other columns are ignored, whatever their names.
    """
    rule, says = rule_of(rules)
    rows = with_parts(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("says", says)
    labelled = materialise(rows.where(F.col("says").isNotNull()).select("url", "host", "path", (F.col("says") == "block").alias("blocked")), "labelled-urls")
    model = fit(labelled, trees)
    marked = rows.select("page_id", "url", "host", "path", "rule", "says", *(v.cast("double").alias(k) for k, v in _lexical().items()))
    marked = _with_suffix_rates(marked, model.suffixes, model.prior)
    scored = marked.withColumn("bins", _binned(marked, model.names, model.cuts)).withColumn("score", model.score())
    verdict = F.coalesce("says", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's address."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
