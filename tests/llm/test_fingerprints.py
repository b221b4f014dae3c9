import hashlib
import math
import random
from collections import Counter

import numpy as np

from turfline.llm import fingerprints as fp
from turfline.llm import queries


def test_levels_against_brute_force(monkeypatch):
    monkeypatch.setattr(fp, "_STEP", 37)
    r = random.Random(5)
    for n in (0, 5, 31, 32, 33, 200):
        text = bytes(r.choices(b"abcdef \xc3\xa9", k=n))
        want = []
        for k in range(n - 31):
            s = sum(int(fp._F[c]) for c in Counter(text[k : k + 32]).values())
            want.append((fp._TOP - s) * 255 // fp._TOP)
        assert fp.levels(text).tolist() == want
    assert abs(fp._TOP / fp._SCALE - 32 * math.log2(32)) < 1e-3


def expected(rows):
    """doc_id, n_chars and edited text of rows in order."""
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        out.append((doc, len(text), text[: len(text) - n] + after[:n]))
    return out


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = sorted((x.doc_id, x.text) for x in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = {x.doc_id: x for x in queries.op8_improbable_features(spark, d).collect()}
    assert len(got) == len(rows)
    same = {}
    for (doc, chars, edited), (_, text) in zip(expected(rows), rows, strict=True):
        x = got[doc]
        assert x.n_chars == chars and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert same.setdefault(text, x.fingerprint) == x.fingerprint
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
    long = [x for x in got.values() if x.n_chars > 300]
    assert np.mean([x.near_edited for x in long]) > 0.55
    assert np.mean([x.near_edited > x.near_next for x in long]) > 0.97


def test_odd_rows(spark):
    rows = [(5, "é" * 9), (1, None), (2, ""), (3, "short"), (9, "ab " * 500), (None, "null id"), (9, "ab " * 500)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string")
    got = fp.fingerprint(docs.repartition(3)).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((str(x.doc_id), len(x.text), x.edited_text) for x in got) == sorted((str(a), b, c) for a, b, c in expected(order))
    one = fp.fingerprint(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].near_edited == 1.0
    assert fp.fingerprint(docs.limit(0)).count() == 0


def test_likeness():
    r = random.Random(1)
    words = [f"{r.randrange(16**6):x}" for _ in range(5000)]
    ranks = np.arange(fp.LEVELS)
    make = lambda x: fp.Digest(fp.features(" ".join(x).encode(), ranks))
    a, b, c = make(words[:2000]), make(words[:1500] + words[3000:3500]), make(words[3000:])
    assert fp.likeness(a, a) == 1.0 and fp.likeness(a, b) == fp.likeness(b, a)
    assert fp.likeness(a, b) > 0.5 and fp.likeness(a, c) < 0.05
    none = make([])
    assert fp.likeness(none, none) == 1.0 and fp.likeness(none, a) == 0.0


def test_every_text_but_the_empty_has_features():
    r = random.Random(8)
    random_ranks = list(range(fp.LEVELS))
    r.shuffle(random_ranks)
    for ranks in (np.arange(fp.LEVELS), np.arange(fp.LEVELS)[::-1], np.array(random_ranks)):
        make = lambda x: fp.Digest(fp.features(x, ranks))
        for n in range(1, 101):
            pair = [bytes(r.choices(b"abcdefgh ijk,\n", k=n)) for _ in range(2)]
            a, b = map(make, pair)
            assert a.size and b.size and fp.likeness(a, a) == 1.0
            assert pair[0] == pair[1] or n < 3 or fp.likeness(a, b) < 0.8, pair
        for period in (1, 2, 4, 8, 16, 32):
            one, two = bytes(range(40, 40 + period)), bytes(range(90, 90 + period))
            for n in (48, 50, 1000, 200_000):
                a, b = make((one * n)[:n]), make((two * n)[:n])
                assert 0 < a.size <= 32 and fp.likeness(a, a) == 1.0 and fp.likeness(a, b) < 0.5
                assert n < 100 or fp.likeness(a, make((one * n)[1 : n + 1])) == 1.0
    assert fp.Digest(fp.features(b"", np.arange(fp.LEVELS))).size == 0


def test_a_shared_doc_id_is_dealt_over_many_partitions(spark):
    rows = [(7, f"text {k} of the shared id") for k in range(3000)] + [(k, f"own text {k}") for k in range(1000) if k != 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed, names, repeats = fp._told_apart(docs.select("doc_id", "text"))
    assert repeats is None
    sizes = [len(x) for x in fp._in_order(keyed, names).rdd.glom().collect()]
    assert sum(sizes) <= len(rows) + 4 * fp._BLOCKS and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    got = fp.fingerprint(docs).collect()
    assert sorted((x.doc_id, x.text) for x in got) == sorted(rows)
    after = {}
    for x in got:
        n = len(x.text) // 4
        after.setdefault(x.doc_id, []).append((x.text, x.edited_text[len(x.text) - n :]))
    assert after[5] == [("own text 5", "ow")] and after[999] == [("own text 999", "own")]
    assert sum(tail == "own t" or tail == "own te" for _, tail in after[7]) == 1  # only the last of the shared id's rows is followed by another id


def test_rows_that_repeat_both_are_one_row_where_texts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(fp, "_REPEATS", 700)
    rows = [(5, "the same text of the same id")] * 3000 + [(k, f"own text {k}") for k in range(1000)] + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed, names, repeats = fp._told_apart(docs)
    assert sorted((x.doc_id, x.n) for x in repeats.collect() if x.doc_id) == [(5, 3000)] and repeats.count() == 2
    sizes = [len(x) for x in fp._in_order(keyed, names).rdd.glom().collect()]
    assert sum(sizes) <= 1002 + 4 * fp._BLOCKS and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    got = fp.fingerprint(docs).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    same = [x for x in got if x.text.startswith("the same")]
    tails = sorted(x.edited_text[-7:] for x in same)
    other = [t for t in tails if t != "the sam"]
    assert len(other) == 1 and other[0] == "own tex"  # one of them is followed by another text
    assert all(x.near_next == 1.0 for x in same if x.edited_text.endswith("the sam"))
    nulls = [x for x in got if x.doc_id is None]
    assert len(nulls) == 3 and all(x.text == x.edited_text == "" for x in nulls) and sorted(x.near_next for x in nulls) == [0.0, 1.0, 1.0]
    one = fp.fingerprint(spark.createDataFrame([(1, "alone")] * 4, "doc_id long, text string")).collect()
    assert len(one) == 4 and {x.edited_text for x in one} == {"alona"}
