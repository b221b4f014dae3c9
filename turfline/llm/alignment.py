"""Alignment of two tokenizers' tokens over a corpus, by exact-text deduplication.

Documents are shuffled by their full text and each distinct text is tokenised and aligned once. Where tokens of a
byte-level BPE (A) and of a sentence-piece BPE (B) end at the same byte, both are cut, and all tokens of A and B between
two cuts are linked. How many documents hold a pair of ids linked is summed with the texts' multiplicities, and what
follows from these counts goes back to every doc_id by the SHA-256 of its text.

In both tokenizers no token goes on from a character that isn't white space into a space, so a text is cut there, and
what a piece between two such places gives doesn't depend on the rest. A worker keeps what it found for short pieces, in
two generations of KNOWN of them at most.

Scale: a text's distinct pairs are stored as sorted numbers, compressed. Texts form blocks of BLOCK characters, and a
block asks once for each of its pairs, however many of its texts have it: a pair that all texts have costs a row for each
block. The answers meet the block's texts in one group, whose size BLOCK bounds. The counts themselves grow with the
corpus and are never broadcast; only the best count of each id of A is, at most a row for each entry of its vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm import packing
from turfline.llm.common import cut, texts

KNOWN, SHORT, MANY, SLICE, BLOCK = 250_000, 48, 4096, 1 << 18, 1 << 24
_CUT = re.compile(r"(?<=\S)(?= )")
_WIDE = re.compile(r"\s ")  # else every space follows a character that isn't white space
_SPACE = "▁"  # how pieces of B write a space
_MEASURED = "key binary, copies long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"
_TYPES = [pa.binary(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary()]
_RATED = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_names = lambda schema: [x.split()[0] for x in schema.split(", ")]

#: What is known of a piece: tokens of A, of B, groups, links, the groups as text, the pair of each link; where a group has very many links, their number by pair.
Found = tuple[int, int, int, int, str, bytes] | tuple[int, int, int, int, str, bytes, Counter]


class Aligner:
    """One for each worker process; the paths name files that every machine has. Pieces are given without the space that each begins with."""

    def __init__(self, byte_path: str, piece_path: str):
        self.encoder = packing._encoder(byte_path)
        self.a_size = [0] * self.encoder.n_vocab
        for raw, k in self.encoder._mergeable_ranks.items():
            self.a_size[k] = len(raw)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.width = self.pieces.vocab_size()
        piece = self.pieces.id_to_piece
        self.b_bytes = [bytes([int(piece(k)[3:-1], 16)]) if self.pieces.is_byte(k) else piece(k).replace(_SPACE, " ").encode() for k in range(self.width)]
        self.b_size = list(map(len, self.b_bytes))
        self.known: dict[str, Found | tuple[()]] = {}
        self.older: dict[str, Found | tuple[()]] = {}

    def encoded(self, pieces: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """Each piece with its ids of A and of B. B adds the space itself, but to nothing."""
        for text, b in zip(pieces, self.pieces.encode(pieces, num_threads=1), strict=True):
            a = self.encoder.encode_ordinary(f" {text}") if len(text) <= SHORT else [k for part in packing._encoded(self.encoder, f" {text}") for k in part]
            yield text, a, b if text else [self.pieces.piece_to_id(_SPACE)]

    def piece(self, text: str, a: list[int], b: list[int]) -> Found | tuple[()]:
        """What is found in a piece with these ids; () if the tokens' bytes aren't the piece's."""
        if b"".join([self.b_bytes[k] for k in b]) != f" {text}".encode():
            return ()
        a_size, b_size, width = self.a_size, self.b_size, self.width
        i = j = end_a = end_b = 0
        groups, pairs, many = [], array("q"), None
        while i < len(a):
            first_a, first_b = i, j
            end_a, end_b = end_a + a_size[a[i]], end_b + b_size[b[j]]
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a += a_size[a[i]]
                    i += 1
                else:
                    end_b += b_size[b[j]]
                    j += 1
            if i - first_a == 1 == j - first_b:
                groups.append(f"{a[first_a]}|{b[first_b]}")
                pairs.append(a[first_a] * width + b[first_b])
                continue
            own, other = a[first_a:i], b[first_b:j]
            groups.append(f"{','.join(map(str, own))}|{','.join(map(str, other))}")
            if len(own) * len(other) <= MANY:
                pairs.extend([x * width + y for x in own for y in other])
            else:
                many, others = many or Counter(), Counter(other)
                for x, n in Counter(own).items():
                    for y, m in others.items():
                        many[x * width + y] += n * m
        found = len(a), len(b), len(groups), len(pairs) + (many.total() if many else 0), ";".join(groups), pairs.tobytes()
        return (*found, many) if many else found

    def _filled(self, pieces: list[str], found: list[Found | tuple[()] | None]) -> list[Found | tuple[()]]:
        """found without gaps. Short pieces are kept for other texts, in two generations: what is met again goes to the younger one."""
        own = {}
        for p in {p for p, x in zip(pieces, found, strict=True) if x is None}:
            own[p] = self.older.get(p)
        for p, a, b in self.encoded([p for p, x in own.items() if x is None]):
            own[p] = self.piece(p, a, b)
        self.known.update((p, x) for p, x in own.items() if len(p) <= SHORT)
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        return [own[p] if x is None else x for p, x in zip(pieces, found, strict=True)]

    def text(self, text: str) -> tuple | None:
        """(n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs in order, links of each) of space+text; None without tokens."""
        whole, at, digest, sums = f" {text}", 0, hashlib.sha256(), [0, 0, 0, 0]
        pairs, links = np.empty(0, np.int64), np.empty(0, np.int64)
        while at < len(whole):
            place = _CUT.search(whole, at + SLICE)
            end = place.start() if place else len(whole)
            part = whole[at:end]
            pieces = [x[1:] for x in _CUT.split(part)] if _WIDE.search(part) else part[1:].split(" ")
            found = list(map(self.known.get, pieces))
            if None in found:
                found = self._filled(pieces, found)
            if () in found:
                return None
            n_a, n_b, n_groups, n_links, lines, each = zip(*[x[:6] for x in found], strict=True)
            sums = [s + sum(x) for s, x in zip(sums, (n_a, n_b, n_groups, n_links), strict=True)]
            digest.update(((";" if at else "") + ";".join(lines)).encode())
            more = np.frombuffer(b"".join(each), np.int64)
            pairs, links = np.concatenate((pairs, more)), np.concatenate((links, np.ones(len(more), np.int64)))
            for x in found:
                if len(x) > 6:
                    pairs, links = np.append(pairs, list(x[6])), np.append(links, list(x[6].values()))
            pairs, links = summed(pairs, links)
            at = end
        return *sums, digest.hexdigest(), pairs, links


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[firsts], np.add.reduceat(values[order], firsts)


@cache
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)  # the numbers' first bytes, then their second ones: most planes are zero


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64)


def _pairs(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data))


def _measured(distinct: DataFrame, byte_path: str, piece_path: str, block: int) -> DataFrame:
    """A row for each distinct text that has tokens. Texts of one block stand together in one partition."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, held = _aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out = []
            for key, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = aligner.text(text)
                if found is None:
                    continue
                if held > block:
                    number, held = number + 1, 0
                held += len(text)
                *counts, digest, pairs, links = found
                out.append((key, copies, number, *counts, digest, _packed(np.diff(pairs, prepend=0)), _packed(links)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(_TYPES)], _names(_MEASURED))

    return distinct.select("key", "text", "copies").mapInArrow(measure, _MEASURED)


def _asked(measured: DataFrame) -> DataFrame:
    """(block, pair, documents): of each block its distinct pairs, and how many documents of its texts hold them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(block: int, held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
            pairs = np.concatenate([p for p, _ in held])
            pairs, documents = summed(pairs, np.array([n for _, n in held], np.int64).repeat([len(p) for p, _ in held]))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(documents)], ["block", "pair", "documents"])

        at, held = None, []
        for batch in batches:
            for block, copies, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and block != at:
                    yield row(at, held)
                    held = []
                at = block
                held.append((_pairs(pairs), copies))
        if held:
            yield row(at, held)

    return measured.select("block", "copies", "pairs").mapInArrow(ask, "block long, pair long, documents long")


def _rate(measured: pa.Table, answers: pa.Table) -> pa.Table:
    """Of one block: what the answers say of its texts."""
    known, documents, best = (answers.column(c).to_numpy() for c in ("pair", "documents", "best"))
    order = np.argsort(known)
    known, documents, best = known[order], documents[order], best[order]
    n_best, count_sum = [], []
    for pairs, links in zip(measured.column("pairs").to_pylist(), measured.column("links").to_pylist(), strict=True):
        at, links = np.searchsorted(known, _pairs(pairs)), _unpacked(links)
        n_best.append(int(links[best[at]].sum()))
        count_sum.append(int((links * documents[at]).sum()))
    own = ["key", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*[measured.column(c) for c in own], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), measured.column("groups_sha256")], _names(_RATED))


def align(docs: DataFrame, byte_path: str, piece_path: str, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    byte_path: a byte-level BPE file of `tokenizers` (A), whose special tokens are plain text here; piece_path: a
    sentence-piece BPE model whose pieces hold spaces at their start alone (B). n_best: links whose pair is in as many
    documents as any of its id of A; count_sum: the sum of these numbers of documents over links. groups_sha256: of
    `a1,a2|b1;a3|b2,b3`. Null and empty texts, and texts with a character that B writes otherwise (U+2581), have no
    tokens: zeros, and '' as groups_sha256. Rows that repeat a doc_id or a text count as documents each and get a row each;
    a null doc_id stays null. Other columns of docs are ignored; an empty table gives an empty table.
    """
    rows = texts(docs)
    distinct = rows.where("text != ''").groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", _key())
    measured = cut(_measured(distinct, byte_path, piece_path, block))
    width = _aligner(byte_path, piece_path).width
    counts = cut(_asked(measured).groupBy("pair").agg(F.sum("documents").alias("documents")))
    best = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("documents").alias("most"))
    rated = counts.join(F.broadcast(best), F.expr(f"pair div {width}") == F.col("a")).select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))
    answers = _asked(measured).select("block", "pair").join(cut(rated), "pair")
    of = cut(measured.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_rate, _RATED))  # so that AQE splits the join with a text that many documents have
    out = rows.select("doc_id", _key().alias("key")).join(of, "key", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def _key():
    return F.unhex(F.sha2("text", 256))
