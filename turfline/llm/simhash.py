"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

A fingerprint's bit is 1 if it is set in more than half of the XXH64 hashes of the text's three-word shingles. Two
fingerprints within RADIUS = 3 bits of each other have a number between them that is at most two flips from the one and
one from the other, so both emit it as a variant and meet there. Which of all the variants are needed follows from
parity: numbers at an odd distance differ in the parity of their ones. Every fingerprint emits its 64 variants of one
flip. Only an even one emits itself and its variants of two flips, and of those only pairs of bits of the same half:
of three differing bits two always lie in one half. So

- at distance 1 the odd fingerprint's flip is the even fingerprint itself,
- at distance 2 each flips one of the two bits,
- at distance 3 the even one flips two bits of one half, the odd one the third.

Where fingerprints meet, those that flipped one bit are within two flips of each other and within three of everyone else
there. So the least of them is linked to all others: as many links as fingerprints, the same components as all pairs. A
variant is met by 1,057 even and 64 odd fingerprints at most, whatever the corpus, so no group of one grows with the input.

Scale: equal fingerprints are one from the first shuffle on, whatever the number of their documents. Variants are dealt
by a hash of the variant over as many buckets as keep a bucket near BUCKET variants; of one fingerprint's variants in a
bucket the fingerprint is sent once, with two bytes for each flip. Only links and components move after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm import hashing
from turfline.llm.common import cut, texts
from turfline.llm.components import components

WIDTH, SEED, RADIUS, HALF = 3, 42, 3, 32
BUCKET = 1 << 20  # variants
_CHUNK = 1 << 11  # fingerprints whose variants are made at a time
_SHINGLES = 1 << 16  # hashed at a time
_ROWS = 8_000  # documents for each file of a checkpoint

#: The bits that a variant flips, by its code: first none, then one bit, then two bits of a half.
_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_TWO = np.array([_ONE[a] | _ONE[b] for low in (0, HALF) for a in range(low, low + HALF) for b in range(a + 1, low + HALF)], np.uint64)
FLIPS = np.concatenate((np.zeros(1, np.uint64), _ONE, _TWO))
_EVEN, _ODD = np.arange(len(FLIPS), dtype=np.uint16), np.arange(1, 65, dtype=np.uint16)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Of a text in UTF-8. A text of fewer words than width is one shingle; one without words has fingerprint 0."""
    starts, ends = hashing.word_spans(text)
    if not len(starts):
        return 0
    line = b" ".join(text.lower().split())  # of bytes: A-Z alone, and at the same white space as words
    stops = np.cumsum(ends - starts + 1)
    begins = np.concatenate(([0], stops[:-1]))
    n = max(1, len(starts) - width + 1)
    begins, stops = begins[:n].tolist(), (stops - 1)[min(width, len(stops)) - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _SHINGLES):
        found = np.array([digest(line[a:z], SEED) for a, z in zip(begins[at : at + _SHINGLES], stops[at : at + _SHINGLES], strict=True)], "<u8")
        ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((_ONE[2 * ones > n]).sum(dtype=np.uint64))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x or b"", width) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "bits"])

    return texts(docs).mapInArrow(sign, "doc_id long, bits long")


def variants(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of bits, code of the flips) for each variant that the fingerprints emit."""
    even = np.bitwise_count(bits) % 2 == 0
    a, b = np.flatnonzero(even), np.flatnonzero(~even)
    return np.concatenate((a.repeat(len(_EVEN)), b.repeat(len(_ODD)))), np.concatenate((np.tile(_EVEN, len(a)), np.tile(_ODD, len(b))))


def _dealt(fingerprints: DataFrame, buckets: int) -> DataFrame:
    """(bucket, bits, counts, codes): which fingerprints have variants in a bucket, how many each, and their codes one after the other."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), _CHUNK):
                bits = whole[at : at + _CHUNK]
                which, codes = variants(bits)
                bucket = (hashing.mix(bits[which] ^ FLIPS[codes]) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")  # within a bucket a fingerprint's variants stay together
                bucket, which, codes = bucket[order], which[order], codes[order]
                firsts = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(which, prepend=-1) != 0))
                counts = np.diff(firsts, append=len(which)).astype(np.int16)
                heads = np.flatnonzero(np.diff(bucket[firsts], prepend=-1))
                runs = pa.array(np.append(heads, len(firsts)).astype(np.int32))
                bytes_ = pa.array((2 * np.append(firsts[heads], len(which))).astype(np.int32))
                columns = [
                    pa.array(bucket[firsts[heads]]),
                    pa.ListArray.from_arrays(runs, pa.array(bits[which[firsts]].view(np.int64))),
                    pa.ListArray.from_arrays(runs, pa.array(counts)),
                    pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, bytes_.buffers()[1], pa.py_buffer(codes.astype("<u2").tobytes())]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "bits", "counts", "codes"])

    return fingerprints.select("bits").mapInArrow(deal, "bucket int, bits array<long>, counts array<short>, codes binary")


def links(bits: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that meet at a variant: the least that flipped one bit with each other one. bits, codes: of each variant."""
    met = bits ^ FLIPS[codes]
    order = np.argsort(met, kind="stable")
    met = met[order]
    same = met[1:] == met[:-1]
    order = order[np.append(same, False) | np.append(False, same)]  # variants that several emit
    if not len(order):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    bits, codes = bits[order], codes[order]
    met = bits ^ FLIPS[codes]
    starts = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
    sizes = np.diff(starts, append=len(met))
    hubs = np.where((codes >= 1) & (codes <= 64), bits, np.uint64(0xFFFFFFFFFFFFFFFF))
    hub = np.minimum.reduceat(hubs, starts).repeat(sizes)
    near = (hub != bits) & (np.bitwise_count(hub ^ bits) <= RADIUS)  # without any single flip there is no hub, and no link
    pairs = np.unique(np.column_stack((hub[near], bits[near])), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _collide(table: pa.Table) -> pa.Table:
    flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), "<u2")
    a, b = links(flat("bits").view(np.uint64).repeat(flat("counts")), codes)
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links reach, for each row of docs.

    Fingerprints of RADIUS differing bits or fewer are linked. Null, empty and all-blank texts have fingerprint 0, which
    is linked like any other. Rows that repeat a doc_id, or doc_id and text, get a row each. A null doc_id never is a
    component_id unless all of its component's are null. Other columns of docs are ignored; an empty table gives an empty table.
    """
    signed = cut(_signed(docs, width))
    tasks = 1 + signed.count() // _ROWS
    classes = cut(signed.groupBy("bits").agg(F.min("doc_id").alias("least")), tasks)
    odd = F.bit_count("bits") % 2
    emitted = classes.agg(F.sum(F.when(odd == 0, len(_EVEN)).otherwise(len(_ODD)))).first()[0] or 0
    pairs = _dealt(classes, 1 + emitted // BUCKET).groupBy("bucket").applyInArrow(_collide, "a long, b long")
    roots = components(pairs, tasks)
    joined = classes.join(cut(roots, tasks), F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    named = cut(joined, tasks)
    least = cut(named.groupBy("component").agg(F.min("least").alias("component_id")), tasks)
    of = cut(named.join(least, "component").select("bits", "component_id"), tasks)  # so that AQE splits the join with a fingerprint that many documents have
    out = signed.join(of, "bits")
    return out.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
