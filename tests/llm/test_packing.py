import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from turfline.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def corpus(n=150):
    r = random.Random(4)
    return [(k, " ".join(r.choices(["the", "of", "tion", "é%", "\n"], k=r.choice([0, 1, 5, 60, 300, 2500])))) for k in range(n)] + [(n, None), (n + 1, ""), (3, "again"), (None, "none")]


def check(rows, pieces, capacity, parts):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((doc is None, doc or 0, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for doc, text in rows)
    docs, sequences = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        docs.setdefault((p.doc_id is None, p.doc_id or 0, p.doc_tokens), []).append((p.start, bytes(p.ids)))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted((a, b, b"".join(ids for _, ids in sorted(x))) for (a, b, _), x in docs.items()) == want
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    used = sum(p.length for p in pieces)
    assert capacity * len(sequences) <= 1.02 * used + capacity * parts


def test_every_id_is_packed_once_with_little_padding(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int").repartition(2)
    for capacity in (1024, 64):
        check(rows, packing.pack(docs, PATH, capacity).collect(), capacity, 2)


def test_ids_are_those_of_the_library():
    from test_bpe import ODD, random_texts

    texts = [x or "" for x in ODD] + random_texts(11, 300)
    texts += [x.text for x in pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["text"]).to_pandas().itertuples()]
    tokenizer = Tokenizer.from_file(PATH)
    for text in texts:
        assert np.frombuffer(packing._ids_of(PATH, text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_very_long_texts(monkeypatch):
    from turfline.llm import segments

    words = "the caf\u00e9's  12,000 <|endoftext|> don't\n\n\tend " * 2000
    tokenizer = Tokenizer.from_file(PATH)
    for size in (segments.SLICE, 1000):
        monkeypatch.setattr(segments, "SLICE", size)
        for text in (words, "a" * 100_000 + " b", " " * 100_000, "\n " * 50_000, "!" * 60_000 + words):
            assert np.frombuffer(packing._ids_of(PATH, text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(packing._ids_of(PATH, " " * 3_000_000 + "x" * 1_000_000)) > 0


def test_added_tokens_in_texts(spark):
    e = "<|endoftext|>"
    texts = [e, e + e, e + " at the start", "in the" + e + "middle", "in the  " + e + "  wide\n" + e + "\n middle", "at the end " + e, "at the end" + e]
    texts += ["<|endoftext|", "<" + e + ">", "no token", "", f"x {e} y" * 900, " " + e + " ", "don" + e + "'t"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    check(rows, packing.pack(docs, PATH).collect(), 1024, 2)
    tokenizer = Tokenizer.from_file(PATH)
    for text in texts:
        assert np.frombuffer(packing._ids_of(PATH, text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_cuts_fit_their_classes():
    for rest in range(1024):
        found = packing.cuts(rest)
        assert sum(n for n, _ in found) == rest
        assert all(n <= 1024 // k for n, k in found)
        assert sum(1024 // k - n for n, k in found) <= 16


def test_query_gives_checksums(spark):
    got = queries.op2_harmonic_packing(spark, "/root/testdata/sf0.001").where("start = 0").limit(3).collect()
    docs = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(PATH)
    for x in got:
        ids = np.array([*tokenizer.encode(docs[x.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert x.ids_crc32 == zlib.crc32(ids[: x.length].tobytes()) and x.doc_tokens == len(ids)
