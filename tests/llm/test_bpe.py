import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from turfline.llm import bpe
from turfline.llm.segments import SegmentTable

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [
    None, "", " ", "  ", "a", " a", "  a", "a  b", "a \n b", "a\n b", "\n\na", "don't  'll I'M", "é ñandú ß 中文字符 日本語", "x" * 3000, " " * 50 + "q", "1234 56.78, 9",
    "tab\tand\x0bvt\x1cfs\x85nel\xa0nbsp\u3000wide \u2028 z", "a\x1c b", "\x1f a", "<|endoftext|> hi", "emoji 👩‍👩‍👧 🏳️‍🌈", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "…—“quoted”", "a\u200bb \u180e c", "١٢٣ ²³ Ⅷ",
]


def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ranks, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(seed, n=120):
    r = random.Random(seed)
    pieces = ["the", "tion", " ", "  ", "\n", "\t", "é", "ß", "中", "ing", "'s", "'", "12", ".", "%%%", "Z", "q", "🙂", "\xa0", "a" * 9]
    return ["".join(r.choices(pieces, k=r.randint(0, 80))) for _ in range(n)]


def test_round_trip_equals_the_library(spark):
    texts = ODD + random_texts(3)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, ids long")
    got = {x.doc_id: x for x in bpe.round_trip(docs, PATH, PATTERN).collect()}
    _, encoding = library()
    for k, text in enumerate(texts):
        assert list(got[k].ids) == encoding.encode_ordinary(text or ""), text
        assert bytes(got[k].decoded) == (text or "").encode(), text


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    coded = bpe.encode(docs, PATH, PATTERN)
    assert sorted((x.doc_id is None, x.doc_id, bytes(x.decoded)) for x in bpe.decode(coded, PATH, PATTERN).collect()) == sorted([(False, 1, b"a b"), (True, None, b"a b"), (False, 1, b"a b"), (False, 2, b"")], key=str)
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_replay_takes_merges_in_the_order_of_each_word(seed):
    r = random.Random(seed)
    tokens = {bytes([k]): k for k in range(256)}
    while len(tokens) < 256 + 60:  # ranks in any order, so that merges make earlier ones possible
        a, b = r.choices([t for t in tokens if set(t) <= set(b"abc") and len(t) < 5], k=2)
        tokens.setdefault(a + b, len(tokens))
    later = [t for t in tokens if len(t) > 1]
    ranks = list(range(256, 256 + len(later)))
    r.shuffle(ranks)
    tokens.update(zip(later, ranks, strict=True))
    words = ["".join(r.choices("abc", k=r.randint(1, 14))).encode() for _ in range(200)]
    encoding = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=tokens, special_tokens={})
    assert [np.frombuffer(x, "<i4").tolist() for x in bpe.Merges(tokens).replay(words)] == [encoding.encode_ordinary(w.decode()) for w in words]


def test_long_texts_are_cut_at_segments(monkeypatch):
    from turfline.llm import segments

    texts = [" ".join(random_texts(5, 40)), "z" * 500, " x" * 300]
    merges, table, _ = bpe._loaded(PATH, PATTERN)
    whole = list(table.ids_of(texts))
    monkeypatch.setattr(segments, "SLICE", 50)
    monkeypatch.setattr(segments, "KEPT", 30)
    assert list(SegmentTable(table.encode).ids_of(texts)) == whole
