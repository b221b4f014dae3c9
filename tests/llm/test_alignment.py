"""Alignment of two tokenizers against the libraries on whole texts and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turfline.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Libraries:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte = {chr(k): k for k in shown} | {chr(0x100 + n): k for n, k in enumerate(k for k in range(256) if k not in shown)}

    def tokens(self, text):
        """[(id, bytes)] of A and of B, or None."""
        if not text:
            return None
        coded = self.a.encode(" " + text, add_special_tokens=False)
        a = [(k, bytes(self.byte[c] for c in self.a.id_to_token(k))) for k in coded.ids]
        b = []
        for k in self.b.encode(text):
            piece = self.b.id_to_piece(k)
            b.append((k, bytes([int(piece[3:-1], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None

    def groups(self, text):
        """[(ids of A, ids of B)] or None."""
        if (found := self.tokens(text)) is None:
            return None
        ends = []
        for side in found:
            at, out = 0, []
            for _, raw in side:
                at += len(raw)
                out.append(at)
            ends.append(out)
        common = set(ends[0]) & set(ends[1])
        out = []
        for side, end in zip(found, ends, strict=True):
            groups = [[]]
            for (k, _), e in zip(side, end, strict=True):
                groups[-1].append(k)
                if e in common:
                    groups.append([])
            out.append(groups[:-1])
        return list(zip(*out, strict=True))


def slow(libraries, rows):
    """Of each (doc_id, text) what the query returns."""
    all_groups = [libraries.groups(text) for _, text in rows]
    documents = Counter()
    for groups in all_groups:
        documents.update({(a, b) for own, other in groups or () for a in own for b in other})
    best = defaultdict(int)
    for (a, _), n in documents.items():
        best[a] = max(best[a], n)
    out = []
    for (doc, _), groups in zip(rows, all_groups, strict=True):
        if groups is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a, b) for own, other in groups for a in own for b in other]
        line = ";".join(f"{','.join(map(str, own))}|{','.join(map(str, other))}" for own, other in groups)
        digest = hashlib.sha256(line.encode()).hexdigest()
        n_a, n_b = sum(len(x) for x, _ in groups), sum(len(x) for _, x in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(documents[x] == best[x[0]] for x in links), sum(documents[x] for x in links), digest))
    return out


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "  a   b ", "a\n b\n\n  c", "tab\t tab", "\x1c x\x1d y", "x\x85 y\xa0 z", "it's we'll  'tis", "<|endoftext|> <s> </s> <unk>", "▁", "a ▁b", "naïve Ähre 中文 日本語 ok",
    "😀 👩‍👩‍👧 é", "=" * 300 + " " + "-" * 77, " " * 300 + "x", "x" + " " * 41, "  em", "0x00\x00 \x00", "<0x41> A", "1234567890 12 3",
]


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def result(docs, **options):
    return sorted((tuple(x) for x in alignment.align(docs, A, B, **options).collect()), key=str)


def test_pieces_give_what_whole_texts_give(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN", 20)
    monkeypatch.setattr(alignment, "SLICE", 64)
    monkeypatch.setattr(alignment, "MANY", 3)
    aligner, r = alignment.Aligner(A, B), random.Random(3)
    marks = [" ", "  ", "\n", "\t ", "word", "Wörter", "don't", "42", "...", "=", "中", "😀", " a", "\x1f", "\xa0", "s"]
    for text in [*ODD, *("".join(r.choices(marks, k=r.randint(1, 80))) for _ in range(300))]:
        if not text:
            continue
        groups, found = libraries.groups(text), aligner.text(text)
        assert (groups is None) == (found is None), repr(text)
        if groups is not None:
            n_a, n_b, n_groups, n_links, digest, pairs, links = found
            linked = Counter((a, b) for own, other in groups for a in own for b in other)
            assert (n_a, n_b, n_groups, n_links) == (sum(len(x) for x, _ in groups), sum(len(x) for _, x in groups), len(groups), linked.total()), repr(text)
            assert digest == hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest()
            assert {divmod(p, aligner.width): n for p, n in zip(pairs.tolist(), links.tolist(), strict=True)} == linked


def test_numbers_come_back_from_their_bytes():
    import numpy as np

    for x in ([], [0], [5, 6, 7_000_000_000], [1 << 40]):
        assert alignment._unpacked(alignment._packed(np.array(x, np.int64))).tolist() == x


def test_odd_rows_and_copies(spark, libraries):
    r = random.Random(5)
    rows = [(k if k % 7 else None, x) for k, x in enumerate(ODD)] + [(100 + k, "the same text again") for k in range(40)] + [(9, "the text"), (9, "the text"), (9, "the other")]
    rows += [(200, " ".join(r.choices(["alpha", "beta", "gamma,", "délta"], k=60_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "pairs": F.lit("x"), "block": F.lit(None)})
    wanted = sorted(slow(libraries, rows), key=str)
    assert result(docs.repartition(3)) == wanted
    assert result(docs.repartition(3), block=5) == wanted  # a block for each text
    assert result(docs.limit(0)) == []


def test_whole_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == sorted(slow(libraries, [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]), key=str)
