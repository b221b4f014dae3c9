"""Harmonic packing of tokenized documents into sequences.

Class k takes pieces of at most capacity // k tokens, and a bin of class k is full at k pieces: no bin ever looks at
another's contents, so every task fills its own bins while it reads, without a shuffle. Since documents may be cut, a
document gives full sequences first, then pieces of exactly a class's length, until what is left nearly fills a class.
When a task has read everything, the pieces in its open bins (fewer than k for class k, whatever the input) are joined
end to end and cut at the capacity, so that a task leaves at most one sequence that isn't nearly full.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from turfline.llm.common import texts
from turfline.llm.segments import slices

CAPACITY, CLASSES, END = 1024, 128, 0
#: How byte-level tokenizer files of this kind split texts before merging; possessive, so that a long run is read once.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A run of white space (Unicode's) that is too long for the pattern's lookahead.
_WIDE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_TYPES = [pa.int64()] * 6 + [pa.binary()]
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


@cache
def _encoder(path: str) -> tiktoken.Encoding:
    """One for each worker process. path: a byte-level BPE tokenizer file of `tokenizers` that every machine has.

    Its vocabulary goes to the faster encoder of tiktoken, which gives the same ids where ids grow with the rank of
    merges, as in such files; added tokens in a text are ordinary text here (see _ids_of).
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the file writes these bytes as themselves, others from U+0100 on
    others = [k for k in range(256) if k not in set(printable)]
    byte = {chr(k): k for k in printable} | {chr(0x100 + n): k for n, k in enumerate(others)}
    special = {x["content"] for x in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """What splits a text at the added tokens of a tokenizer file, and their ids. They are matched in texts as they stand, before anything else."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: an added token that takes more or less than its own text")
    longest_first = sorted((x["content"] for x in added), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None, {x["content"]: x["id"] for x in added}


def _encoded(encoder: tiktoken.Encoding, text: str) -> Iterator[list[int]]:
    """The ids of a text without added tokens, in parts. A wide run of white space is one match of the pattern, but for its last character, if anything follows."""
    at = 0
    for run in _WIDE.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield from map(encoder.encode_ordinary, slices(text[at : run.start()]))
        yield encoder._encode_single_piece(text[run.start() : end])
        at = end
    yield from map(encoder.encode_ordinary, slices(text[at:] if at else text))


def _ids_of(path: str, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers: those of its added tokens, and of the parts between them on their own.

    A long text is encoded a slice at a time.
    """
    encoder, (token, ids) = _encoder(path), _added(path)
    out = []
    for k, part in enumerate(token.split(text) if token else [text]):
        for found in [[ids[part]]] if k % 2 else _encoded(encoder, part):
            made = array("I", found)
            if sys.byteorder == "big":
                made.byteswap()
            out.append(made.tobytes())
    return b"".join(out)


@cache
def cuts(rest: int, capacity: int = CAPACITY, classes: int = CLASSES) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces that a rest shorter than the capacity is cut into."""
    if not rest:
        return ()
    holder = max(k for k in range(1, min(classes, capacity) + 1) if capacity // k >= rest)
    slot = capacity // holder
    if holder == min(classes, capacity) or slot - rest <= slot >> 6:
        return ((rest, holder),)
    length = max(capacity // k for k in range(1, classes + 1) if capacity // k <= rest)
    exact = max(k for k in range(1, classes + 1) if capacity // k >= length)
    return ((length, exact), *cuts(rest - length, capacity, classes))


class _Bins:
    def __init__(self, task: int, capacity: int, classes: int):
        self.next, self.capacity, self.classes = task << 33, capacity, classes
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []
        self.held = 0

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, tokens, ids in pieces:
            self.done.append((doc, start, len(ids) // 4, tokens, self.next, offset, ids))
            offset += len(ids) // 4
        self.held += 4 * offset
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        tokens = len(ids) // 4
        whole = tokens - tokens % self.capacity
        for start in range(0, whole, self.capacity):
            self.close([(doc, start, tokens, ids[4 * start : 4 * (start + self.capacity)])])
        for length, k in cuts(tokens - whole, self.capacity, self.classes):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, whole, tokens, ids[4 * whole : 4 * (whole + length)]))
            whole += length
            if len(bin_) == k:
                self.close(self.open.pop(k))

    def close_all(self) -> None:
        room, pieces = self.capacity, []
        for k in sorted(self.open):
            for doc, start, tokens, ids in self.open[k]:
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    pieces.append((doc, start, tokens, part))
                    start, room = start + len(part) // 4, room - len(part) // 4
                    if not room:
                        self.close(pieces)
                        room, pieces = self.capacity, []
        if pieces:
            self.close(pieces)
        self.open = {}

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*self.done, strict=True), _TYPES, strict=True)], _NAMES)
        self.done, self.held = [], 0
        return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, classes: int = CLASSES, end: int = END) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids are the piece's token ids, little-endian unsigned 32-bit, added tokens in a text included; the last piece of each document ends with the id
    `end`, which doc_tokens counts. A null or empty text is that id alone. Repeated rows, or a null doc_id, are packed
    like any others. sequence_id is unique over all tasks; offsets in a sequence have no gaps. Other columns of docs
    are ignored; an empty table gives an empty table.
    """
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = _Bins(TaskContext.get().partitionId(), capacity, classes)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bins.add(doc, _ids_of(tokenizer_path, text or "") + last)
                if bins.held > 1 << 21:
                    yield bins.take()
        bins.close_all()
        if bins.done:
            yield bins.take()

    return texts(docs).mapInArrow(run, _SCHEMA)
