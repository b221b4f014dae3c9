import random
import re

import numpy as np
import pytest

from turfline.llm import hashing, minhash


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lowered)


def shingle_set(text):
    found = words(text)
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def brute(rows):
    sets = [shingle_set(text) for _, text in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k in range(len(rows)):
        for j in range(k):
            both = len(sets[k] & sets[j])
            if sets[k] and sets[j] and 100 * both >= 75 * len(sets[k] | sets[j]):
                label[root(k)] = root(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    return sorted(
        (doc, len(sets[k]), least.get(root(k)) if sets[k] else doc, (doc == least.get(root(k)) if sets[k] else True)) for k, (doc, _) in enumerate(rows) if doc is not None
    )


def corpus(seed, n=240):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = " ".join(r.choices(vocabulary, k=60))
    hot = r.choices(vocabulary, k=60)
    rows = []
    for k in range(n):
        kind = k % 6
        if kind == 0 and rows:
            text = r.choice(rows)[1]
        elif kind == 1:  # near copies of one text, of similarities on both sides of the threshold
            edited = list(hot)
            for _ in range(r.randint(1, 5)):
                edited[r.randrange(60)] = r.choice(vocabulary)
            text = " ".join(edited)
        elif kind == 2:
            text = shared + " " + " ".join(r.choices(vocabulary, k=r.randint(1, 60)))
        elif kind == 3 and rows:
            base = words(r.choice(rows)[1])
            text = "  ".join(base[: len(base) * r.randint(70, 100) // 100]).upper()
        elif kind == 4:
            text = " ".join(r.choices(vocabulary, k=r.randint(0, 7)))
        else:
            text = "\n".join(r.choices(vocabulary, k=r.randint(1, 200)))
        rows.append((k, text))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "é ü ñ"), (n + 4, "É ü ñ"), (n + 5, rows[5][1])]


def run(spark, data, **options):
    docs = spark.createDataFrame([(d, t, "x", True) for d, t in data], "doc_id long, text string, component_id string, kept boolean")
    return sorted((tuple(x) for x in minhash.near_duplicates(docs.repartition(3), **options).collect()), key=lambda x: (x[0] is None, x))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_large_buckets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEADERS", 1)
    rows = [x for x in corpus(7) if x[0] % 6 in (1, 2)]
    assert run(spark, rows, bands=48, rows=1) == brute(rows)  # rows=1: buckets of many that aren't similar


def test_chains_of_near_copies(spark):
    r = random.Random(3)
    base = [f"v{k}" for k in range(70)]
    rows = []
    for k in range(120):  # around the threshold: many pairs are links, many are not
        edited = list(base)
        for at in r.sample(range(70), r.randint(0, 4)):
            edited[at] = f"x{k}_{at}"
        rows.append((k, " ".join(edited)))
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    got = run(spark, [(1, text), (1, text), (None, text), (2, text), (None, None)])
    assert got == [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (None, 0, None, True), (None, 4, 1, False)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keeps_one_of_each_with_all_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (3, "A b c d e f", "t"), (4, None, None)], "doc_id long, text string, kept string")
    assert sorted(map(tuple, minhash.keep_one_of_each(docs).collect())) == [(1, "a b c d e f", "s"), (4, None, None)]


def test_keeps_every_group_of_null_and_shared_ids(spark):
    text = lambda k: " ".join(f"w{k}_{j}" for j in range(12))
    rows = [(None, text(k)) for k in range(30)] + [(None, text(0)), (None, text(1).upper())]  # groups of their own, and two copies
    rows += [(7, text(40)), (7, text(41)), (7, text(41)), (5, text(41) + " more"), (8, text(42)), (None, text(42))]
    rows += [(None, None), (None, ""), (None, " \n"), (9, "é ü"), (9, "É"), (9, " é  ü\n")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, digest string")
    got = minhash.keep_one_of_each(docs.repartition(3))
    assert got.columns == docs.columns
    got = [(x.doc_id, x.text) for x in got.collect()]
    fold = lambda t: " ".join((t or "").replace("W", "w").split())
    filled = sorted((d or 0, fold(t)) for d, t in got if fold(t))
    want = [(0, text(k)) for k in range(30)] + [(7, text(40)), (5, text(41) + " more"), (8, text(42)), (9, "é ü"), (9, "É")]
    assert filled == sorted(want)
    assert sorted(str(t) for _, t in got if not fold(t)) == ["", " \n", "None"]


def test_long_words_and_blocks_hash_alike(monkeypatch):
    text = ("ab " * 1000 + "x" * 5000 + " tail " + "q" * 300).encode()
    starts, ends = hashing.word_spans(text)
    whole = hashing.span_hashes(text, starts, ends)
    monkeypatch.setattr(hashing, "BLOCK", 97)
    assert (hashing.span_hashes(text, starts, ends) == whole).all()
    assert len(set(whole.tolist())) == 4


def test_signature_estimates_similarity():
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    same = (minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean()
    assert abs(same - 1 / 3) < 0.04


def test_columns_of_any_name_come_through(spark):
    text = "one two three four five six seven eight nine ten"
    names = ["doc_id", "__doc_id", "text", "__digest", "__many", "many", "component", "digest", "c1", "least"]
    rows = [(k, 10 + k, x, b"d", True, 1, 2, "x", 3.5, k) for k, x in enumerate([text, text, text.upper(), "quite another text of this table", "", None])]
    for given in (rows, rows + [rows[0]] * 3):  # the kept row repeats, too
        docs = spark.createDataFrame(given, names)
        got = minhash.keep_one_of_each(docs)
        assert got.columns == names
        assert sorted(x["__doc_id"] for x in got.collect()) == [10, 13, 14, 15]


def test_more_ids_than_the_smallest_bitmap(spark, monkeypatch):
    from turfline.llm import common

    monkeypatch.setattr(common, "_LEAST", 1 << 6)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(docs).collect() if x.doc_id is not None) == brute(rows)
    ids = docs.select("doc_id").where("doc_id % 3 = 0")
    near = {x.doc_id for x in common.likely(docs, ids).collect()}
    wanted = {x.doc_id for x in ids.collect()}
    assert wanted <= near and len(near - wanted) <= len(rows) // 4
    monkeypatch.setattr(common, "_MOST", 1 << 7)
    assert common.likely(docs, ids).count() == len(rows)
