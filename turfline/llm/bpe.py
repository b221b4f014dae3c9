"""Byte-level BPE: encoding by merge replay over a chunk's distinct words, and decoding.

The words of a chunk of the corpus lie end to end in one array of tokens, each word a linked list. An inverted index
leads from a mergeable pair (named by the token it becomes) to the positions where it stands; merges are applied in
rank order, each to all of its positions, and only the two pairs that touch a merged position are looked up anew.
A chunk is what a task holds of its part of the corpus at a time (some 4 MB of texts), not the corpus itself; distinct
words that were replayed stay in a bounded table, so a task replays a word about once. Nothing is shuffled, and the
vocabulary of the corpus may be of any size. Where a merge makes one of an earlier rank possible, that word alone is
finished by rescanning it, so the order within the word stays right.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm.common import texts
from turfline.llm.segments import SegmentTable

_STEP = 1 << 16  # ids that are decoded at a time
_GROUP = 4 << 20  # bytes of texts whose words are replayed together


class Merges:
    """The ranks of a vocabulary: token bytes to ids, and pairs of ids to the id that they merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.after = [{} for _ in range(1 + max(ranks.values()))]  # after[left].get(right): what the two merge into
        for t, r in ranks.items():
            for k in range(1, len(t)):
                if (left := ranks.get(t[:k])) is not None and (right := ranks.get(t[k:])) is not None:
                    self.after[left][right] = r
        self.bytes = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self.byte_pairs = np.array([[self.after[a].get(b, -1) for b in self.bytes.tolist()] for a in self.bytes.tolist()], np.int32)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers. A word that is a token is that token."""
        whole = self.ranks.get
        out = [b"" if (r := whole(w)) is None else r.to_bytes(4, "little") for w in words]
        left = [k for k, x in enumerate(out) if not x]
        data = np.frombuffer(b"".join([words[k] for k in left]), np.uint8)
        ends = np.cumsum([len(words[k]) for k in left], dtype=np.int64)
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1], before[np.concatenate(([0], ends[:-1]))[: len(ends)]] = -1, -1
        merged = self.byte_pairs[data, np.append(data[1:], 0)] if len(data) else np.empty(0, np.int32)
        merged[ends - 1] = -1
        spots: dict[int, list[int]] = {}  # the inverted index
        order = np.argsort(merged, kind="stable")
        order = order[np.searchsorted(merged[order], 0) :]
        found, firsts = np.unique(merged[order], return_index=True)
        for rank, positions in zip(found.tolist(), np.split(order, firsts[1:]) if len(found) else (), strict=True):
            spots[rank] = positions.tolist()
        token = self._merge_all(self.bytes[data].tolist(), after.tolist(), before.tolist(), spots)
        kept = np.array(token, "<i4")
        alive = kept >= 0
        blob, upto = kept[alive].tobytes(), (4 * np.cumsum(alive)[ends - 1]).tolist() if len(ends) else []
        at = 0
        for k, end in zip(left, upto, strict=True):
            out[k], at = blob[at:end], end
        return out

    def _merge_all(self, token: list[int], after: list[int], before: list[int], spots: dict[int, list[int]]) -> list[int]:
        """Applies the merges in rank order to all words at once; a token that has gone into another becomes -1."""
        pairs = self.after
        ranks = list(spots)
        heapify(ranks)
        while ranks:
            rank = heappop(ranks)
            positions = spots.pop(rank)
            positions.sort()
            for at in positions:
                other = after[at]
                here = token[at]
                if other < 0 or here < 0 or pairs[here].get(token[other]) != rank:
                    continue  # a neighbour has changed since
                token[at], token[other] = rank, -1
                far, near = after[other], before[at]
                after[at] = far
                lower = False
                if far >= 0:
                    before[far] = at
                    r = pairs[rank].get(token[far])
                    if r is not None:
                        lower = r < rank
                        if r in spots:
                            spots[r].append(at)
                        else:
                            spots[r] = [at]
                            heappush(ranks, r)
                if near >= 0:
                    r = pairs[token[near]].get(rank)
                    if r is not None:
                        lower = lower or r < rank
                        if r in spots:
                            spots[r].append(near)
                        else:
                            spots[r] = [near]
                            heappush(ranks, r)
                if lower:  # an earlier merge has become possible: in this word it comes before this rank's other positions
                    self._finish(at, token, after, before)
        return token

    def _finish(self, at: int, token: list[int], after: list[int], before: list[int]) -> None:
        """All merges of the word at a position, the least rank first, the leftmost of equal ones."""
        while before[at] >= 0:
            at = before[at]
        while True:
            best, left = None, at
            while after[left] >= 0:
                r = self.after[token[left]].get(token[after[left]])
                if r is not None and (best is None or r < best[0]):
                    best = r, left
                left = after[left]
            if best is None:
                return
            rank, left = best
            gone = after[left]
            token[left], token[gone] = rank, -1
            after[left] = after[gone]
            if after[gone] >= 0:
                before[after[gone]] = left


@cache
def _loaded(path: str, pattern: str) -> tuple[Merges, SegmentTable, list[bytes]]:
    """One for each worker process. path: a rank file that every machine has."""
    with open(path, "rb") as lines:
        merges = Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
    split = regex.compile(pattern).findall

    def encode(segments: list[str]) -> list[bytes]:
        parts = [split(x) for x in segments]
        words = list(set().union(*parts)) if parts else []
        ids = dict(zip(words, merges.replay([w.encode() for w in words]), strict=True))
        return [b"".join(map(ids.__getitem__, x)) for x in parts]

    tokens = [b""] * (1 + max(merges.ranks.values()))
    for token, rank in merges.ranks.items():
        tokens[rank] = token
    return merges, SegmentTable(encode), tokens


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to _GROUP bytes each, so that a replay has many words."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= _GROUP:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    table = _loaded(path, pattern)[1]
    for batch in _grouped(batches):
        ids = list(table.ids_of([x or "" for x in batch.column(1).to_pylist()]))
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    tokens = _loaded(path, pattern)[2]
    data = np.frombuffer(b"".join(tokens), np.uint8)
    sizes = np.array([len(x) for x in tokens], np.int64)
    starts = np.cumsum(sizes) - sizes

    def known(ids: np.ndarray) -> bool:
        if not len(ids):
            return True
        if not (ids.min() >= 0 and ids.max() < len(sizes)):  # a null among the ids is NaN, which fails both
            return False
        return bool(sizes[ids.astype(np.int64, copy=False)].all())

    def bytes_of(ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64, copy=False)
        out = []
        for at in range(0, len(ids), _STEP):
            part = ids[at : at + _STEP]
            n = sizes[part]
            ends = np.cumsum(n)
            out.append(data[np.repeat(starts[part] - ends + n, n) + np.arange(int(n.sum()))].tobytes())
        return b"".join(out)

    for batch in batches:
        ids = batch.column(1)
        bounds, values, valid = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False), ids.is_valid().to_pylist()
        decoded = [bytes_of(values[a:z]) if there and known(values[a:z]) else None for a, z, there in zip(bounds, bounds[1:], valid, strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) for each row of docs; a null or empty text has no ids. Special tokens are ordinary text.

    Rows that repeat, or have a null doc_id, are encoded like any others; other columns are ignored.
    """
    return texts(docs).mapInArrow(lambda batches: _encode(batches, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (the bytes that the ids stand for; null for null ids, or with one that the vocabulary lacks) for each row with doc_id and ids."""
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lambda batches: _decode(batches, path, pattern), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """decode(encode(docs)) in one pass."""
    return texts(docs).mapInArrow(lambda batches: _decode(_encode(batches, path, pattern), path, pattern), "doc_id long, ids array<int>, decoded binary")
