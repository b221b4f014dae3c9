import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from turfline.llm import queries, rules


def slow_counts(text):
    text = text or ""
    found = re.findall("[^\x20\x09-\x0d]+", text)
    lines, repeated = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in lines
            lines.add(line)
    runs = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    marked = {k + j for k, x in enumerate(runs) if runs.count(x) > 1 for j in range(3)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(marked)


def test_base_counts_against_brute_force():
    r = random.Random(1)
    cases = [None, "", " \n", "a", "é　ü b", "a b c a b c", "x\n\nx\n x\nx", "\r\n\r\n"]
    cases += ["".join(r.choices(["a", "b", "é", " ", " ", "\n", "#", "|", "\t", "\x0b", "\x85"], k=r.randint(0, 120))) for _ in range(200)]
    for text in cases:
        assert rules.base_counts((text or "").encode()) == slow_counts(text), text


def test_query_over_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = {x.doc_id: x for x in queries.op9_ngram_quality_rules(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for x in docs:
        n, chars, symbols, lines, repeats = slow_counts(x.text)
        got = rows[x.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert got.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (got.base_failed and got.kept)


def test_verdicts_follow_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = rules.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert sum(x.kept == (x.quality == 1) for x in got) >= 0.97 * len(got)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (None, "a b", 1.0), (2, "w " * 60, 0.0), (2, "w " * 60, 0.0), (3, " ".join(map(str, range(99))), 0.0)], "doc_id long, text string, ratio double")
    labels = spark.createDataFrame([(3, 1), (None, 1), (3, None), (77, 0)], "doc_id long, quality int")
    got = {(x.doc_id, x.n_words): x for x in rules.judge(docs, labels).collect()}
    assert len(got) == 4 and got[(3, 99)].kept and not got[(1, 0)].kept
    assert rules.judge(docs, labels.limit(0)).where("kept").count() == 1
    assert rules.judge(docs.limit(0), labels).count() == 0


def test_target_counts_all_trusted_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    ratios = lambda n: {x.doc_id: x.ratio for x in rules.judge(docs, labels, n).collect()}
    assert ratios(3) == ratios(10_000)  # the bound is for the threshold alone
    good = {x.doc_id for x in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for x in docs.collect():
        text = (x.text or "").encode()
        found = Counter(rules.grams(text).tolist())
        raw.update(found)
        if x.doc_id in good:
            target.update(found)
    table = rules.ratio_table(*rules.counted(docs, labels.where("quality = 1").select("doc_id")))
    smooth = lambda c, k: math.log((c[k] + 1 / rules.BUCKETS) / (sum(c.values()) + 1))
    for k in [*list(raw)[:2000], next(k for k in range(rules.BUCKETS) if k not in raw)]:
        assert abs(table[k] - (smooth(target, k) - smooth(raw, k))) < 1e-9


def test_buckets_part_the_4_grams_of_a_corpus(spark):
    texts = [(x.text or "").encode() for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    runs = {t[k : k + 4] for t in texts for k in range(len(t) - 3)}
    assert len({k for t in texts for k in rules.grams(t).tolist()}) > 0.95 * len(runs)


def test_every_label_teaches_the_threshold(spark):
    r = random.Random(3)
    fine, poor = [f"fine{k}" for k in range(40)], [f"poor{k}" for k in range(40)]
    prose = lambda share: " ".join(r.choice(fine if r.random() < share else poor) for _ in range(51))
    by_hash = [x.id for x in spark.range(8300).orderBy(F.xxhash64("id"), "id").collect()]
    middling = {*by_hash[8192:], *range(10_000, 10_050)}  # the last labels of 8,300, and rows without one
    docs = [(k, prose(0.75 if k in middling else 0)) for k in [*by_hash, *range(10_000, 10_050)]] + [(k, prose(1)) for k in range(20_000, 20_100)]
    known = [(k, 0) for k in by_hash] + [(k, 1) for k in range(20_000, 20_100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in rules.judge(frame, spark.createDataFrame(known, "doc_id long, quality int")).collect()}
    assert len(got) == len(docs) and not any(x.base_failed for x in got.values())
    assert {k for k, x in got.items() if x.kept} == set(range(20_000, 20_100))


def test_every_row_of_a_label_teaches(spark):
    r = random.Random(6)
    prose = lambda share: " ".join(("fine" if r.random() < share else "poor") + str(r.randint(0, 39)) for _ in range(51))
    made = spark.createDataFrame([(prose(share),) for share in [0] * 90 + [0.75] * 90], "text string").select("text", (F.xxhash64("text") < 0).alias("low")).collect()
    poor, middling = [x.text for x in made[:90] if x.low][:20], [x.text for x in made[90:] if not x.low][:30]  # one text for each id, that of the least hash, would be a poor one
    docs = [*enumerate(poor), *enumerate(middling[:20]), *((-1 - k, x) for k, x in enumerate(middling[20:])), *((k, prose(1)) for k in range(100, 130))]
    known = [(k, int(k >= 100)) for k in [*range(20), *range(100, 130)]]
    got = rules.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int")).collect()
    assert len(got) == len(docs) == 80 and {x.doc_id for x in got if x.kept} == set(range(100, 130))


def slow_threshold(good, bad):
    if not good or not bad:
        return min(good) - 1e-9 if good else -math.inf
    points = sorted({*good, *bad})
    cuts = [(points[0] - 1e-9, 0.0)] + [((a + b) / 2, b - a) for a, b in zip(points, points[1:], strict=False)]
    worth = lambda c: sum(v < c for v in bad) * len(good) + sum(v >= c for v in good) * len(bad)
    best = max(worth(c) for c, _ in cuts)
    return -max((width, -c) for c, width in cuts if worth(c) == best)[1]


def test_threshold_over_ranges(spark):
    r = random.Random(5)
    draws = [([], []), ([1.0, 2.0], []), ([], [1.0]), ([0.5], [0.5]), ([1.0], [2.0]), ([2.0], [1.0]), ([0.0] * 50, [0.0] * 50 + [-0.25])]
    draws += [([r.randint(-9, 20) / 8 for _ in range(n)], [r.randint(-20, 9) / 8 for _ in range(m)]) for n, m in ((7, 5), (90, 60), (60, 90))]
    draws += [([r.gauss(0.3, 1) for _ in range(300)], [r.gauss(-0.3, 1) for _ in range(200)])]
    for good, bad in draws:
        scores = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "ratio double, trusted boolean").repartition(3)
        for ranges in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            try:
                assert rules._threshold(scores) == slow_threshold(good, bad)
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", "4")
                spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    near = math.nextafter(0.5, 1)
    assert rules._threshold(spark.createDataFrame([(near, True), (0.5, False)], "ratio double, trusted boolean")) == near
