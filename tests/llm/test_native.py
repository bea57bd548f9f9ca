"""URL filters, chat formatting, quality rules, mixing and sharding."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest_llm import EDGE_IDS, EDGES, documents, with_clashes
from stemma.llm import chat, mixing, quality, sharding, urls
from stemma.shared import materialise

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
PYTHON = re.compile(r"Python|Pandas|Arrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Rules of addresses and boosted trees.

URLS = [
    None, "", "no scheme", "http://", "HTTP://Sub.EXAMPLE.ORG/es/1?x=1#y", "https://example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/",
    "http://a.com/fr/", "http://a.com/de/x", "http://com/de/", "http://xcom/de/", "http://a.net/fr/", "x://y://z.org/", "http://org", "http://org?/", "http://a.com#/fr/",
    "http://ÄÖ.org/ß", "http://a.com/" + "b/" * 5000, "http://a.com/fr/", "http://a\nb.org/x\ny",
]


def plain_url(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def url_frame(spark, found, extra=()):
    rows = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    return with_clashes(rows.withColumn("host", F.lit("own")))


def test_url_rules(spark):
    pages = url_frame(spark, URLS + URLS[8:10] * 3)
    rows = urls.judge(pages, trees=3).collect()
    assert len(rows) == len(URLS) + 6
    for r in rows:
        host, path, rule, verdict = plain_url((URLS + URLS[8:10] * 3)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert urls.judge(pages.where("false")).count() == 0
    alone = urls.judge(url_frame(spark, ["http://x.net/", None])).collect()
    assert {r["verdict"] for r in alone} == {"allow"}


def lexical(url):
    host, path, _, _ = plain_url(url)
    n = max(1, len(url))
    shares = [c / n for c in Counter(url).values()]
    return {
        "length": len(url), "host length": len(host), "path length": len(path), "depth": path.count("/"), "host labels": host.count("."),
        "digit ratio": sum(c in "0123456789" for c in url) / n, "hyphen ratio": url.count("-") / n, "entropy": -sum(p * math.log2(p) for p in shares),
        "parameters": 1 + url.count("&") if "?" in url else 0,
    }


def test_url_features(spark):
    found = [u for u in URLS if u is not None]
    rows = urls.with_parts(spark.createDataFrame(list(enumerate(found)), "page_id long, url string"))
    for r in rows.select("url", *(v.cast("double").alias(k) for k, v in urls._lexical().items())).collect():
        for k, v in lexical(r["url"]).items():
            assert r[k] == pytest.approx(v), (k, r["url"])


def test_boosted_trees_learn(spark):
    """Held-out accuracy on addresses that are told apart by folder, digits and parameters."""
    rng = random.Random(1)

    def made(i):
        bad = rng.random() < 0.4
        host = rng.choice(["a.example.net", "b.example.com", "c.site.org"])
        name = "".join(rng.choice("0123456789" if bad else "abcdefgh") for _ in range(12))
        return f"http://{host}/{rng.choice(['ads', 'x'] if bad else ['news', 'x'])}/{name}" + ("?a=1&b=2&c=3" if bad and rng.random() < 0.5 else ""), bad

    rows = [made(i) for i in range(1200)]
    frame = urls.with_parts(spark.createDataFrame(rows, "url string, blocked boolean"))
    train, test = frame.where(F.pmod(F.xxhash64("url"), F.lit(3)) > 0), frame.where(F.pmod(F.xxhash64("url"), F.lit(3)) == 0)
    model = urls.fit(train, trees=6)
    marked = urls._with_suffix_rates(test.select("url", "host", "path", "blocked", *(v.cast("double").alias(k) for k, v in urls._lexical().items())), model.suffixes, model.prior)
    scored = marked.withColumn("bins", urls._binned(marked, model.names, model.cuts)).withColumn("score", model.score())
    got = scored.select("blocked", "score", "bins").collect()
    assert sum((r["score"] >= 0.5) == r["blocked"] for r in got) / len(got) > 0.97
    for r in got[:50]:  # the expression is the trees
        total = model.base + sum(t.of(r["bins"]) for t in model.trees)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))
    again = urls.fit(train, trees=2)
    assert again.trees == model.trees[:2]
    assert not PYTHON.search(plan(scored))


def plain_trees(bins, y, base, trees, depth, rate):
    """Boosting by its definition: every split of every node is tried on the rows themselves."""

    def grown(rows, depth):
        g, h = (sum(v[i] for i in rows) for v in (grad, curve))
        node = urls.Node(round(rate * g / (h + urls.RIDGE), 6))
        best = (1e-6, -1, -1)
        for f in range(len(bins[0])) if depth else ():
            for cut in range(max(bins[i][f] for i in rows)):
                a, c = (sum(v[i] for i in rows if bins[i][f] <= cut) for v in (grad, curve))
                gain = round(a * a / (c + urls.RIDGE) + (g - a) ** 2 / (h - c + urls.RIDGE) - g * g / (h + urls.RIDGE), 6)
                if gain > best[0]:
                    best = (gain, f, cut)
        if best[1] >= 0:
            node.feature, node.cut = best[1:]
            node.left = grown([i for i in rows if bins[i][node.feature] <= node.cut], depth - 1)
            node.right = grown([i for i in rows if bins[i][node.feature] > node.cut], depth - 1)
        return node

    margin, made = [base] * len(y), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad, curve = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]
        made.append(grown(range(len(y)), depth))
        margin = [m + made[-1].of(b) for m, b in zip(margin, bins)]
    return made


def test_boosting_against_plain(spark):
    """Cuts, suffix rates and trees of a small table, and the verdicts of addresses that no rule fits."""
    rng = random.Random(3)
    host = lambda: rng.choice(["a.example.org", "b.org", "c.com", "d.com", "e.net", "f.e.net"])
    found = [f"http://{host()}/{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.choice(['1', 'x.html', 'y9?a=1&b=2', 'q' * rng.randint(1, 40)])}" for _ in range(150)]
    pages = url_frame(spark, found + [None, "none"])
    rows = urls.judge(pages, trees=4).collect()
    plain = {i: plain_url(u) for i, u in enumerate([*found, None, "none"])}
    taught = {i: int(v[3] == "block") for i, v in plain.items() if v[3]}
    prior = (sum(taught.values()) + 0.5) / (len(taught) + 1)

    def suffixes(i):
        h, path = plain[i][:2]
        folder, file = re.match(r"/?([^/]*)/", path), re.search(r"\.[^./]*$", path)
        return {"top suffix": re.search(r"[^.]*$", h)[0], "site suffix": re.search(r"[^.]*\.?[^.]*$", h)[0], "first folder": folder[1] if folder else "", "file suffix": file[0] if file else ""}

    def values(i):
        out = lexical([*found, "", "none"][i])
        for k, v in suffixes(i).items():
            same = [y for j, y in taught.items() if suffixes(j)[k] == v]
            out[k] = (sum(same) + urls.SMOOTH * prior) / (len(same) + urls.SMOOTH)
        return out

    table = {i: values(i) for i in plain}
    cuts = {}
    for k in table[0]:
        v = sorted(table[i][k] for i in taught)
        cuts[k] = sorted({v[math.ceil(q / urls.BINS * len(v)) - 1] for q in range(1, urls.BINS)})
    binned = {i: [sum(c < row[k] - 1e-12 for c in cuts[k]) for k in row] for i, row in table.items()}
    base = round(math.log(prior / (1 - prior)), 9)
    trees = plain_trees([binned[i] for i in taught], list(taught.values()), base, 4, urls.DEPTH, urls.RATE)
    for r in rows:
        score = 1 / (1 + math.exp(-base - sum(t.of(binned[r["page_id"]]) for t in trees)))
        assert r["score"] == pytest.approx(score, abs=2e-6), r["page_id"]
        assert r["verdict"] == (plain[r["page_id"]][3] or ("block" if score >= 0.5 else "allow"))
    assert {r["verdict"] for r in rows if not plain[r["page_id"]][3]} and len(taught) < len(rows)


def test_sample_of_labelled_addresses(spark):
    """The suffix statistics count all rows, the trees are fitted on the bounded sample."""
    rows = [(f"http://h{i % 9}.net/{'ads' if i % 3 == 0 else 'news'}/{i}", i % 3 == 0) for i in range(600)]
    frame = urls.with_parts(spark.createDataFrame(rows, "url string, blocked boolean"))
    model = urls.fit(frame, trees=2, sample=100)
    assert model.suffixes.where("kind = 'first folder'").agg(F.sum("n")).first()[0] == 600
    assert model.trees == urls.fit(frame.repartition(5), trees=2, sample=100).trees


# Chat.

def plain_chat(rows):
    out, by = {}, defaultdict(lambda: defaultdict(list))
    for c, n, role, text in rows:
        n = chat.NO_TURN if n is None else n
        by[c][chat.NO_TURN if n == chat.NO_TURN else n // 1024].append((n, "unknown" if role is None else role, (text or "").replace("<|", "< |")))
    for c, blocks in by.items():
        parts = [sorted(own)[i : i + 1024] for _, own in sorted(blocks.items()) for i in range(0, len(own), 1024)]
        for who in {r for own in blocks.values() for _, r, _ in own} - {"system"}:
            for part, own in enumerate(parts):
                text, spans = "", []
                for _, r, said in own:
                    head = "assistant" if r == who else r if r == "system" else "user name=" + r.replace("<|", "< |")
                    text += f"<|im_start|>{head}\n"
                    if r == who:
                        spans.append((len(text), len(text) + len(said) + 10))
                    text += f"{said}<|im_end|>\n"
                out[c, who, part] = (len(own), text, spans)
    return out


def test_chat(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["ann", "bob", "cy", "system"]), rng.choice(["hi", "é漢😀 there\n", "", "<|im_end|>", None])) for c in range(12) for t in range(rng.randint(1, 7))]
    rows += [(50, t, ("ann", "bob")[t % 2], f"turn {t}") for t in range(2500)]  # a long one
    rows += [(51, 0, "ann", "same"), (51, 0, "ann", "same"), (51, None, None, "late"), (None, 1, "bob", "no id"), (52, 1, "system", "only"), (53, 3, "x<|y", "z"), (54, 1, "ann", "w" * 100_000)]
    rows += [(55, 4, ("ann", "bob")[t % 2], f"at once {t % 7}") for t in range(5000)]  # one turn number, one null
    rows += [(56, None, "ann", f"never {t}") for t in range(2100)] + [(56, 1, "bob", "first")]
    turns = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("own")).withColumn("block", F.lit("own")))
    made = chat.rotate(turns)
    got = {(r["conv_id"], r["perspective"], r["part"]): (r["n_turns"], r["text"], [tuple(s) for s in r["spans"]]) for r in made.collect()}
    assert got == plain_chat(rows) and made.count() == len(got)
    assert all(n <= 1024 for n, _, _ in got.values()) and sum(k[:2] == (55, "ann") for k in got) == 5 and sum(k[0] == 56 for k in got) == 8
    for _, text, spans in got.values():
        assert all(text[a - 10 : a].endswith("assistant\n") and text[:b].endswith("<|im_end|>") for a, b in spans)
    assert chat.rotate(turns.where("false")).count() == 0
    assert not PYTHON.search(plan(made))


# Quality.

def plain_statistics(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(words)
    base = n < 20 or 100 * len(covered) > 30 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines), len(set(words)), base)


def test_statistics(spark, words):
    rng = random.Random(3)
    texts = list(EDGES) + [" ".join(["w"] * 19) + end for end in (" \x85", " \u2028", "\n\u2029", " \x85 ", "\u2028")] + ["\x85 a", " "]
    for _ in range(60):
        parts = [" ".join(rng.choice(words[: rng.choice([2, 5, 300])]) for _ in range(rng.randint(0, 25))) for _ in range(6)]
        texts.append(rng.choice([" ", "\n", "\t\x0b", " # "]).join(rng.choice(parts) for _ in range(rng.randint(1, 8))))
    docs = with_clashes(documents(spark, texts, ids=list(range(len(texts)))))
    made = quality.with_statistics(docs.drop("n_words"))
    for r in made.collect():
        assert tuple(r[c] for c in [*quality.STATISTICS, "base_failed"]) == plain_statistics(texts[r["doc_id"]]), r["doc_id"]
    assert not PYTHON.search(plan(made))


def labelled(rng, words, n):
    texts, good = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        kind = i % 5
        if kind == 0:
            own = [w + rng.choice(["$$$", "###"]) for w in own]
        elif kind == 1:
            own = [w for w in own[: len(own) // 7] for _ in range(7)] + own[:12]
        texts.append(" ".join(own))
        good.append(int(kind > 1))
    return texts, good


def test_decision_list(spark, words):
    """Held-out rows are judged as labelled, clean ones are kept, and the list is short and readable."""
    texts, good = labelled(random.Random(4), words, 500)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good) if i % 2], "doc_id long, quality int, toxic int")
    rules = quality.learn_quality(docs, labels)
    assert 1 <= len(rules.rules) <= 3 and all(len(r) <= 2 for r in rules.rules)
    rows = quality.judge(docs, rules).collect()
    unseen = [r for r in rows if r["doc_id"] % 2 == 0]
    assert all(r["kept"] for r in unseen if good[r["doc_id"]])
    assert sum(r["kept"] for r in unseen if not good[r["doc_id"]]) <= 3
    for r in rows:
        stats = {c: r[c] for c in quality.STATISTICS}
        n, lines = max(1, stats["n_words"]), max(1, stats["n_lines"])
        of = {"words": stats["n_words"], "mean word": stats["word_chars"] / n, "symbols a word": stats["n_symbols"] / n, "repeated lines": stats["n_dup_lines"] / lines, "repeated words": stats["n_repeat_words"] / n, "distinct words": stats["n_distinct_words"] / n}
        first = next((x for x in rules.rules if all((of[c.feature] > c.threshold) == c.above for c in x)), None)
        assert r["rule"] == (" and ".join(map(str, first)) if first else None)
        assert r["kept"] == (not r["base_failed"] and first is None)
    again = quality.learn_quality(docs, labels)
    assert again == rules


def plain_rules(rows):
    """The list by its definition, from rows (features, bad, held)."""
    made, names = [], list(rows[0][0])
    holds = lambda rule, x: all((x[f] > cut) == above for f, above, cut in rule)
    while len(made) < quality.MOST_RULES:
        left = [r for r in rows if not any(holds(rule, r[0]) for rule in made)]
        cuts = {}
        for f in names:
            seen = set()
            for kind in (True, False):
                v = sorted(x[f] for x, bad, _ in left if bad == kind)
                seen |= {v[max(0, math.ceil(k / 20 * len(v)) - 1)] for k in range(21)} if v else set()
            seen = sorted(seen)
            cuts[f] = [((a + b) / 2, (b - a) / (seen[-1] - seen[0])) for a, b in zip(seen, seen[1:])]
        rule = []
        while len(rule) < quality.MOST_CONDITIONS:
            grow = [(x, bad) for x, bad, held in left if not held and holds(rule, x)]
            all_p, all_n = (sum(bad == kind for _, bad in grow) for kind in (True, False))
            if not all_p or not all_n:
                break
            options = []
            for f in names:
                for cut, gap in cuts[f]:
                    for above in (False, True):
                        p, n = (sum(bad == kind and (x[f] > cut) == above for x, bad in grow) for kind in (True, False))
                        gain = p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n))) if p else 0.0
                        options.append((gain, gap, (f, above, cut)))
            most = max(options)[0]
            if most <= 0:
                break
            rule.append(max((o for o in options if o[0] >= quality.NEARLY * most), key=lambda o: (o[1], o[0]))[2])
        if not rule:
            break
        worth = []
        for i in range(len(rule)):
            p, n = (sum(held and bad == kind and holds(rule[: i + 1], x) for x, bad, held in left) for kind in (True, False))
            worth.append(((p - n) / max(1, p + n), p, -i, n))
        _, p, i, n = max(worth)
        if (p + 1) / (p + n + 2) < quality.PRECISION and not (n == 0 and p >= 2):
            break
        made.append(rule[: 1 - i])
    return made


@pytest.mark.parametrize("noise", [0, 7])
def test_decision_list_against_plain(spark, words, noise):
    texts, good = labelled(random.Random(5 + noise), words, 260)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1 - g if noise and i % noise == 0 else g, 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    sample = materialise(quality.labelled_sample(docs, labels), "sample")
    held = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(3)) == 0
    rows = sample.select("bad", held.alias("held"), *(v.alias(k) for k, v in quality.features().items())).collect()
    expected = plain_rules([({k: r[k] for k in quality.features()}, r["bad"], r["held"]) for r in rows])
    got = quality.fit_decision_list(sample).rules
    assert [[(c.feature, c.above, c.threshold) for c in rule] for rule in got] == expected != []


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, 0, 0), (1, 0, 0)], [(None, 0, 1), (2, None, None), (7, 1, 0), (7, 0, 0), (7, 0, 0)]])
def test_few_labels(spark, labels):
    docs = with_clashes(documents(spark, [*EDGES, " ".join(map(str, range(40)))], ids=[*EDGE_IDS, 70]))
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, frame)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [70]
    assert quality.keep_good(docs.where("false"), frame).count() == 0


# Mixing.

def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] * (1 + 1e-12)]
        if not over:
            return full | share
        full |= {s: cap * sizes[s] for s in over}


def mixed(spark, docs, **options):
    return mixing.mix(docs, **options).collect()


def test_mixing(spark, words):
    rng = random.Random(5)
    sources = [rng.choice(["a", "b", "hot", "hot", "hot", "z", "é", None]) for _ in range(700)]
    texts = [" ".join(["w"] * min(3000, int(rng.lognormvariate(4, 1)))) for _ in sources]
    docs = with_clashes(documents(spark, texts, sources))
    rows = mixed(spark, docs)
    sizes = Counter()
    for s, t in zip(sources, texts):
        sizes[s] += len(t.split())
    goals = plain_targets(dict(sizes))
    assert len(rows) == 700
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(goals[s])
        assert sum(r["size"] * r["rate"] for r in own) == pytest.approx(goals[s], rel=1e-4)
        assert sum(r["size"] * r["copies"] for r in own) == pytest.approx(goals[s], rel=0.02)
        for r in own:
            assert math.floor(r["rate"]) <= r["copies"] <= min(3, math.ceil(r["rate"]))
        # Rates are exponential in size / (size + mean): their logarithms lie on one line, up to the cap.
        mean = max(1, round(sum(sizes.values()) / 700))
        slopes = {round(math.log(r["rate"]) * (r["size"] + mean) / r["size"], 3) for r in own if r["rate"] < 3}
        assert len(slopes) <= 1
    key = lambda rs: sorted((r["doc_id"], r["copies"], r["rate"]) for r in rs)
    for parts in (1, 7):  # to the last bit, however rows are spread
        assert key(mixed(spark, docs.repartition(parts))) == key(rows)
    repeated = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert repeated == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_taken_against_plain(spark):
    """Copies of the rounding, turn by turn, from the rates."""
    rng = random.Random(9)
    docs = documents(spark, [" ".join(["w"] * rng.randint(0, 90)) for _ in range(150)], [rng.choice("ab") for _ in range(150)])
    rows = mixed(spark, docs)
    for s in "ab":
        own, copies = [r for r in rows if r["source"] == s], {}
        room = own[0]["target"] - sum(math.floor(r["rate"]) * r["size"] for r in own)
        waiting = []
        for r in own:
            copies[r["doc_id"]] = math.floor(r["rate"])
            rest = r["rate"] - math.floor(r["rate"])
            if rest > 1e-9:
                u = (int(hashlib.md5(f"5:{r['doc_id']}".encode()).hexdigest()[:12], 16) + 1) / (16**12 + 1)
                waiting.append((u / rest, r["doc_id"], r["size"]))
        for _ in range(mixing.TURNS):
            waiting, before, missed, filled = sorted(x for x in waiting if x[2] <= room), 0, [], 0
            for turn, i, size in waiting:
                if before + size <= room:
                    copies[i] += 1
                    filled += size
                else:
                    missed.append((turn, i, size))
                before += size
            waiting, room = missed, room - filled
        assert copies == {r["doc_id"]: r["copies"] for r in own}


def test_small_fractions_are_spread(spark):
    """However small the fractions, no bucket holds more than its part of the waiting documents."""
    n, fraction = 20_000, 1e-6
    bucket = Counter(math.floor(mixing.LEAST_BUCKETS * math.log((i + 1) / n / fraction)) for i in range(n))
    assert max(bucket.values()) <= n / mixing.LEAST_BUCKETS + 2


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5}, {"a": 0, "b": 7}, {None: 4}, {"a": 3, "b": 3000, "c": 1, "d": 2, None: 900}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([("n" if s is None else "s" + s, s, n) for s, n in sizes.items()], "stratum string, source string, source_size long")
    got = {r["stratum"]: r["target"] for r in mixing.targets(frame).collect()}
    for s, t in plain_targets(sizes).items():
        assert got["n" if s is None else "s" + s] == pytest.approx(t)


def test_edges_of_mixing(spark):
    docs = with_clashes(documents(spark, EDGES, ["a", "a", None, None, "b", "b", "c", "c", "c", "d", "d"], ids=EDGE_IDS))
    rows = mixed(spark, docs)
    assert len(rows) == len(EDGES)
    assert sorted(r["size"] for r in rows) == sorted(len(WORDS.findall(t or "")) for t in EDGES)
    assert all(0 <= r["copies"] <= 3 for r in rows)
    assert mixed(spark, docs.where("false")) == [] and mixing.mixed_documents(docs.where("false")).count() == 0
    assert mixing.mixed_documents(docs).count() > 0
    blank = mixed(spark, documents(spark, ["", None, " "]))
    assert [r["copies"] * r["size"] for r in blank] == [0, 0, 0]


# Sharding.

def shards_hold(rows, n, sources):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    counts = [len(by[k]) for k in range(n)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    for s in set(sources):
        share = sources.count(s) / len(sources)
        for x in by.values():
            assert abs(sum(r["source"] == s for r in x) - share * len(x)) <= 2


def test_sharding(spark, words):
    rng = random.Random(6)
    sources = [rng.choice(["hot", "hot", "a", "b", None]) for _ in range(1003)]
    texts = [" ".join(rng.choice(words) for _ in range(3)) for _ in sources]
    docs = with_clashes(documents(spark, texts, sources))
    rows = sharding.interleave(docs, 7).collect()
    shards_hold(rows, 7, sources)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    key = lambda rs: sorted(map(tuple, rs), key=str)
    assert key(sharding.interleave(docs.repartition(5), 7).collect()) == key(rows)
    assert key(sharding.interleave(docs, 7, seed=8).collect()) != key(rows)


def test_edges_of_sharding(spark):
    docs = with_clashes(documents(spark, EDGES, [None, "a"] * 5 + ["a"], ids=EDGE_IDS))
    rows = sharding.interleave(docs, 4).collect()
    shards_hold(rows, 4, [r["source"] for r in rows])
    assert [(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 0] == [(16, 0)]
    assert sharding.interleave(docs.where("false"), 4).count() == 0
    assert len(sharding.interleave(docs, 40).collect()) == len(EDGES)


@pytest.mark.parametrize("name", ["op3_chat", "op7_sharding", "op10_linededup"])
def test_sql_twins(spark, name, tmp_path):
    """Spark and DuckDB agree on edges as well."""
    from stemma.llm.registry import ORACLES, QUERIES

    ids = [i for i in range(len(EDGES))]
    documents(spark, [t for t in EDGES], [None, "a"] * 5 + ["b"], ids=ids).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    talk = [(4, 7, ("ann", "bob")[i % 2], f"{i % 5}") for i in range(2500)] + [(1, 0, "ann", "hi <|x"), (1, 1, "bob", None), (1, None, None, "é😀"), (2, 5, "system", "s"), (2, 1030, "ann", "later"), (3, 1, "ann", ""), (3, 1, "ann", "")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    made = QUERIES[name](spark, str(tmp_path))
    columns = sorted(made.columns)
    found = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, made.select(*columns).collect()), key=str) == sorted(found, key=str)
