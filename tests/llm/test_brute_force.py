"""Models and digests against versions that follow their definitions, on small corpora."""

import base64
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_toxicity import slow_segments

from turfline.llm import fingerprints as fp
from turfline.llm import hashing, quality, rules, toxicity


def prose(r, words, n):
    return " ".join(r.choices(words, k=n))


# -- toxicity ---------------------------------------------------------------------------------------------------------


def names_of(text):
    """The names of each token: its prefixes, then itself."""
    for token in re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower()):
        raw = token.encode()
        yield [(n, raw[:n]) for n in toxicity.PREFIXES if len(raw) >= n] + [(0, raw)]


def key_of(name):
    n, raw = name
    starts, ends = np.array([0]), np.array([len(raw)])
    return int(hashing.span_hashes(raw, starts, ends, fold=True)[0] ^ np.uint64(n))


def test_toxicity_model(spark):
    r = random.Random(4)
    mild, vile = [f"word{k}" for k in range(40)] + ["calm", "kind"], ["wretch", "wretched", "vile", "vilest"]
    rows = [(prose(r, mild, r.randint(5, 60)) + (" " + prose(r, vile, 4) + " " + prose(r, mild, 5) if k % 3 == 0 else " vile" if k % 10 == 1 else ""), int(k % 3 == 0)) for k in range(150)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    counts = Counter()
    for text, bad in rows:
        counts.update((x, bad) for x in {n for names in names_of(text) for n in names})
    toxic, clean = (sum(c for (_, b), c in counts.items() if b == bad) for bad in (1, 0))
    prior = toxicity.PRIOR * min(toxic, clean)
    odds = {}
    for x in {x for x, _ in counts}:
        share = (counts[x, 1] + counts[x, 0]) / (toxic + clean) * prior
        a, b = counts[x, 1] + share, counts[x, 0] + share
        o = math.log(a / (toxic + prior - a)) - math.log(b / (clean + prior - b))
        if abs(o) / math.sqrt(1 / a + 1 / b) >= toxicity.CERTAIN:
            odds[x] = o
    assert odds and {key_of(x): pytest.approx(o) for x, o in odds.items()} == dict(zip(model.keys.tolist(), model.odds.tolist(), strict=True))

    def scores_of(text):
        return [next((odds[n] for n in reversed(names) if n in odds), 0.0) - toxicity.DRIFT for names in names_of(text)]

    for text, _ in rows[:20]:
        data = text.encode()
        assert model.token_scores(data, *toxicity.tokens(data)).tolist() == pytest.approx(scores_of(text))
    grown = sum(c * math.exp(model.rate * (odds.get(x, 0.0) - toxicity.DRIFT)) for (x, bad), c in counts.items() if not bad) / clean
    assert grown == pytest.approx(1, abs=1e-6) and model.rate > 0

    def segments(text):
        s = scores_of(text)
        return len(s), [sum(s[a:z]) for a, z in slow_segments(s)]

    found = [segments(text) for text, _ in rows]
    calm = [model.rate * max(s, default=0) - math.log(n) for (n, s), (_, bad) in zip(found, rows, strict=True) if not bad]
    assert model.log_k == pytest.approx(sum(calm) / len(calm) - 0.5772156649015329)
    level = -math.log(-math.log(1 - toxicity.SIGNIFICANT))
    x, y = [], np.array([bad for _, bad in rows], float)
    for n, s in found:
        normal = [model.rate * v - math.log(n) - model.log_k for v in s]
        x.append((1, min(30, max([-5, *normal])), math.log(1 + sum(v for v in normal if v >= level))))
    x, w = np.array(x), np.array(model.weights)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (y - p) - 0.1 * w).max() < 1e-5  # the best weights under the small ridge
    for (text, _), want in zip(rows, p, strict=True):
        assert model.judge(text.encode())[0] == pytest.approx(want, abs=1e-9)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(400)] + [(2, "other"), (3, "third")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels).count() <= 3
    assert toxicity.training_rows(docs, labels, 1).count() <= 1


# -- quality rules ----------------------------------------------------------------------------------------------------


def test_rules_verdict(spark):
    r = random.Random(7)
    fine, poor = [f"fine{k}" for k in range(80)], [f"poor{k}" for k in range(80)]
    docs = [(k, prose(r, (fine if k % 2 else poor) + ["shared"] * 40, r.randint(40, 120))) for k in range(80)]
    docs += [(80, "again and again " * 40), (81, "short")]
    known = {k: k % 2 for k in range(0, 60)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in rules.judge(frame, spark.createDataFrame(list(known.items()), "doc_id long, quality int")).collect()}
    runs = {k: Counter(rules.grams(t.encode()).tolist()) for k, t in docs}
    target, raw = Counter(), Counter()
    for k, c in runs.items():
        raw.update(c)
        if known.get(k) == 1:
            target.update(c)

    def ratio(own, target, raw):
        size = {id(c): sum(c.values()) for c in (target, raw)}
        log = lambda c, b: math.log((c[b] + 1 / rules.BUCKETS) / (size[id(c)] + 1))
        return sum(n * (log(target, b) - log(raw, b)) for b, n in own.items()) / sum(own.values())

    for k, x in got.items():
        assert x.ratio == pytest.approx(ratio(runs[k], target, raw))
    apart = {k: ratio(runs[k], target - runs[k] if q else target, raw) for k, q in known.items() if not got[k].base_failed}
    good, bad = [v for k, v in apart.items() if known[k]], [v for k, v in apart.items() if not known[k]]
    points = sorted(apart.values())
    cuts = [(points[0] - 1e-9, 0.0)] + [((a + b) / 2, b - a) for a, b in zip(points, points[1:], strict=False)]
    right = lambda c: sum(v >= c for v in good) / len(good) + sum(v < c for v in bad) / len(bad)
    best = max(right(c) for c, _ in cuts)
    low = max((width, -c) for c, width in cuts if right(c) >= best - 1e-9)
    for x in got.values():
        assert x.kept == (not x.base_failed and x.ratio >= -low[1])
    assert {k for k in range(60, 80) if got[k].kept and not got[k].base_failed} == {k for k in range(60, 80) if k % 2 and not got[k].base_failed}


# -- quality classifier -----------------------------------------------------------------------------------------------


def test_counts_of_a_text():
    r = random.Random(9)
    for _ in range(100):
        text = "".join(r.choices(["Ab", "c", "É", "!", "#", " ", " ", "\n", "the the the "], k=r.randint(0, 60)))
        n, chars, symbols, lines, repeats = rules.base_counts(text.encode())
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fold = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words}
        caps, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
        marks = len(re.findall("[!?]", text))
        want = [symbols / max(1, chars), min(1, 5 * symbols / max(1, chars)), caps / max(1, letters), marks / max(1, chars), lines / (1 + text.count("\n")), repeats / max(1, n), len(fold) / max(1, n), math.log(1 + n), chars / max(1, n)]
        assert quality.counts_of(text.encode()) == pytest.approx(want)


def test_evidence_and_strength(spark):
    r = random.Random(3)
    rows = [(k, [r.gauss(k % 2, 1.0) if j < 2 else 0.0 for j in range(quality._N)]) for k in range(300)]
    labels = [(k, k % 2) for k, _ in rows]
    found = quality.fit(spark.createDataFrame(rows, "doc_id long, __x array<double>"), spark.createDataFrame(labels, "doc_id long, quality int"))
    x = np.array([v[:2] for _, v in rows])
    y = np.array([q for _, q in labels], float)
    scale = x.std(axis=0, ddof=1)
    w, b = np.array(found.weights[:2]), found.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert abs((y - p).mean()) < 1e-4 and np.abs(((y - p) @ (x / scale)) / len(y) - 1e-3 * w * scale).max() < 1e-3  # the optimum under the ridge
    groups = [(f"s{k}", r.randint(1, 60), r.random()) for k in range(30)]
    frame = spark.createDataFrame([(s, n, n * rate) for s, n, rate in groups], "s string, n long, total double")
    mean, total = 0.4, sum(n for _, n, _ in groups)
    spread = sum(n * (rate - mean) ** 2 for _, n, rate in groups) / total - sum(rate * (1 - rate) for _, _, rate in groups) / total
    level = sum(n * rate for _, n, rate in groups) / total
    from pyspark.sql import functions as F

    want = min(1e4, max(1.0, level * (1 - level) / max(1e-9, spread) - 1))
    assert quality._strength(frame, F.lit(mean), F.col("n"), F.col("total")) == pytest.approx(want)


# -- fingerprints -----------------------------------------------------------------------------------------------------


def slow_features(text, ranks):
    """Places of the windows that are features."""
    windows = [text[k : k + fp.WINDOW] for k in range(len(text) - fp.WINDOW + 1)]
    level = [(fp._TOP - sum(int(fp._F[c]) for c in Counter(w).values())) * (fp.LEVELS - 1) // fp._TOP for w in windows]
    runs = [range(k, k + fp.RUN) for k in range(max(1, len(windows) - fp.RUN + 1))]
    picks = Counter(min((k for k in run if k < len(windows)), key=lambda k: (ranks[level[k]], k)) for run in runs)
    most = max(picks.values())
    if len(windows) <= fp.RUN:
        return list(picks), False
    return ([k for k, n in sorted(picks.items()) if n >= fp.PICKED], False) if most >= fp.PICKED else ([k for k, n in sorted(picks.items()) if n == most], True)


def slow_digest(found):
    """Bit sets of the chained filters."""
    return [{int(x >> (11 * k)) % fp.BITS for x in found[a : a + fp.FULL] for k in range(fp.HASHES)} for a in range(0, len(found), fp.FULL)]


def slow_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    x, y = sorted((a, b), key=len)
    if len(a) == len(b):
        x, y = a, b
    none = (1 - 1 / fp.BITS) ** fp.HASHES
    out = []
    for p, f in enumerate(slow_digest(x)):
        n, best = len(x[p * fp.FULL : (p + 1) * fp.FULL]), 0.0
        for q, g in enumerate(slow_digest(y)):
            m = len(y[q * fp.FULL : (q + 1) * fp.FULL])
            chance, most = fp.BITS * (1 - none**n) * (1 - none**m), min(len(f), len(g))
            low = chance + 0.3 * max(0, most - chance)
            best = max(best, (len(f & g) - low) / max(most - low, 1e-9) if most > low else 0.0)
        out.append(min(1.0, max(0.0, best)))
    return sum(out) / len(out)


def test_features_digest_and_likeness():
    r = random.Random(12)
    ranks = list(range(fp.LEVELS))
    r.shuffle(ranks)
    array = np.array(ranks)
    texts = [bytes(r.choices(b"abcdef ghi,.\n", k=n)) for n in (32, 33, 47, 48, 60, 300, 6000)] + [b"ab" * 100, b"=" * 70]
    texts.append(texts[-3][:4000] + bytes(r.choices(b"abcdef", k=2500)))
    made = []
    for text in texts:
        places, once = slow_features(text, ranks)
        hashes = fp._hashes(text, np.array(places))
        want = sorted(set(hashes.tolist())) if once else hashes.tolist()
        got = fp.features(text, array).tolist()
        assert got == want, text[:40]
        digest = fp.Digest(np.array(got, np.uint64))
        size, coded = str(digest).split(":")
        bits = np.unpackbits(np.frombuffer(base64.b64decode(coded), np.uint8)).reshape(-1, fp.BITS)
        assert int(size) == len(got) and [set(np.flatnonzero(row).tolist()) for row in bits] == slow_digest(got)
        made.append((got, digest))
    for a, x in made:
        for b, y in made:
            if len(a) != len(b) or a == b:
                assert fp.likeness(x, y) == pytest.approx(slow_likeness(a, b))


# -- very long texts and clashing columns -------------------------------------------------------------------------------


def test_very_long_texts(spark):
    from turfline.llm import minhash, sharding, urls, warc

    r = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    long = prose(r, words, 400_000)  # some 2 MB
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x" * 1_000_000), (4, None), (5, "\n" * 300_000), (6, "a b c d e f g")], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in minhash.near_duplicates(docs).collect()}
    assert (got[2].component_id, got[3].n_shingles, got[5].n_shingles, got[6].n_shingles) == (1, 1, 0, 3)
    shards = {x.doc_id: x for x in sharding.shard_documents(docs).collect()}
    assert shards[3].size == 1_000_008 and shards[4].size == 8
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (6, 0, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.classify(docs, labels).count() == 6 and quality.classify(docs, labels).count() == 6
    judged = {x.doc_id: x for x in rules.judge(docs, labels).collect()}
    assert judged[1].n_words == 400_000 and judged[3].word_chars == 1_000_000 and judged[5].base_failed
    prints = {x.doc_id: x for x in fp.fingerprint(docs).collect()}
    assert prints[1].near_next > 0.9 and prints[3].fingerprint != prints[5].fingerprint
    pages = spark.createDataFrame([(1, "http://a.com/" + "p" * 500_000, "<html>"), (2, "h" * 500_000, None)], "page_id long, url string, html string")
    assert {x.page_id: len(x.path) for x in urls.judge(pages).collect()} == {1: 500_001, 2: 0}
    found = warc.resolve_revisits(warc.captures(pages.withColumn("html", pages.url)))
    assert found.count() == 6 and {x.outcome for x in found.where("canonical_url is null").collect()} == {"no_response"}


def test_clashing_columns_come_through(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    odd = docs.selectExpr("*", "doc_id as __x", "source as __host", "lang as __path", "0 as __n", "text as c1", "1 as __score")
    want = sorted(x.doc_id for x in quality.keep_good(docs, labels).collect())
    got = quality.keep_good(odd, labels)
    assert got.columns == odd.columns
    rows = got.collect()
    assert sorted(x.doc_id for x in rows) == want and all(x["__x"] == x.doc_id and x["c1"] == x.text for x in rows)


def test_unknown_ids_decode_to_null(spark):
    import public_tokenizers

    from turfline.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    frame = spark.createDataFrame([(1, [0, 1]), (2, [10**8]), (3, [-1]), (4, None), (5, []), (6, [None, 1])], "doc_id long, ids array<int>")
    got = {x.doc_id: x.decoded for x in bpe.decode(frame, path, public_tokenizers.PATTERN).collect()}
    assert [got[k] is None for k in range(1, 7)] == [False, True, True, True, False, True]
