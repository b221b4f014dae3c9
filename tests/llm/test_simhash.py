"""SimHash groups against brute force over all pairs of fingerprints."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from turfline.llm import simhash


def _slow_fingerprint(text: str) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(fingerprints: list[int]) -> list[int]:
    """For each place the least place that is linked, by comparing all pairs."""
    root = list(range(len(fingerprints)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(fingerprints)), 2):
        if (fingerprints[a] ^ fingerprints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(root))]


def test_fingerprints_of_odd_and_long_texts():
    rng = np.random.default_rng(1)
    words = ["Ähre", "the", "FOX", "of", "a", "\x1d", "\x85", "jumps\xa0over", "Z"]
    texts = ["", " \t\n", "One", "one TWO", "a b c", "a  b\tc\x0bd\x0ce\rf"]
    texts += [" ".join(rng.choice(words, n)) for n in (3, 10, 500)] + ["one two three " * 40_000]
    for text in texts:
        assert simhash.fingerprint(text.encode()) == _slow_fingerprint(text), text[:40]


def test_every_pair_within_three_bits_meets_and_no_other():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 12, dtype=np.uint64)
    made = [int(x) for x in seeds]
    for seed in seeds[:8]:
        for flips in (1, 2, 3, 3, 3, 4, 4, 5):
            made.append(int(seed) ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    made = sorted(set(made))
    bits = np.array(made, np.uint64)
    which, codes = simhash.variants(bits)
    a, b = simhash.links(bits[which], codes)
    assert all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b, strict=True))
    place = {x: k for k, x in enumerate(made)}
    root = list(range(len(made)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        old, new = root[place[y]], root[place[x]]
        root = [new if r == old else r for r in root]
    wanted = _groups(made)
    assert len({*zip(root, wanted, strict=True)}) == len(set(root)) == len(set(wanted))


def test_any_three_bits_hold_two_of_one_half():
    flips = set(simhash.FLIPS.tolist())
    for a, b, c in combinations(range(64), 3):
        assert any((1 << x | 1 << y) in flips for x, y in ((a, b), (a, c), (b, c)))


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    made = [_slow_fingerprint(x) for x in rows["text"]]
    ids = rows["doc_id"].tolist()
    wanted = {(d, f"{f:016x}", ids[r]) for d, f, r in zip(ids, made, _groups(made), strict=True)}
    assert {tuple(x) for x in simhash.near_duplicates(docs).collect()} == wanted


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog by the river"
    rows = [(None, text, 1), (7, text, 2), (5, text.upper(), 3), (5, text, 4), (3, None, 5), (2, "", 6), (9, " \n", 7), (4, "another text of quite other words", 8), (None, "nobody else has this one", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits int").withColumn("component_id", F.lit("clash"))
    got = sorted(((x.doc_id, x.component_id) for x in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 5), (7, 5), (5, 5), (5, 5), (3, 2), (2, 2), (9, 2), (4, 4), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_many_copies_and_many_near_ones_stay_one_group(spark):
    words = [f"w{k}" for k in range(400)]
    near = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(0, 400, 4)]
    docs = spark.createDataFrame([(k, " ".join(words)) for k in range(600)] + [(1000 + k, x) for k, x in enumerate(near)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()}
    ids = sorted(got)
    made = [_slow_fingerprint(" ".join(words))] * 600 + [_slow_fingerprint(x) for x in near]
    assert [got[d] for d in ids] == [ids[r] for r in _groups(made)]
