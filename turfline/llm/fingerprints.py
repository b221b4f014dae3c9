"""Document fingerprints: digests of improbable features in chained Bloom filters, compared by normalised bit overlap.

Every window of WINDOW bytes has an entropy, in LEVELS steps; the rarer its level is among all windows of the corpus,
the lower its rank. In each run of RUN windows the first of the lowest rank is picked, and a window that is picked by
PICKED runs is a feature. Where no window is picked as often (texts of a few runs, or of a period that leaves each window
its level), the most picked ones are features, each content once. A feature sets HASHES bits of a filter of BITS bits; after FULL features a new filter begins.
Two filters are as alike as their common bits exceed what chance gives, relative to the most that is possible; two
digests are the mean, over the filters of the one with fewer, of the best match in the other.

Scale: one pass counts levels (LEVELS sums reach the driver). To bring each text beside its successor, texts are dealt
once, in blocks of consecutive doc_ids, a shared id's rows in several blocks by hashes of their texts, and a block's
first text is copied to the block before: block bounds, a few for each shuffle partition, are all that the driver sees.
Rows that repeat both doc_id and text are one row there; all but the last of them are followed by an equal text, so they are
made apart from the rest, _REPEATS at a time.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.llm.common import cut, marked, texts
from turfline.llm.hashing import mix

WINDOW, LEVELS, RUN, PICKED = 32, 256, 16, 4
BITS, HASHES, FULL = 2048, 5, 160
_SCALE = 1 << 12
_F = np.array([0] + [round(n * math.log2(n) * _SCALE) for n in range(1, WINDOW + 1)], np.int64)
_G = np.diff(_F, prepend=0)
_TOP = int(_F[WINDOW])
_STEP = 1 << 16
_BLOCKS = 4  # for each shuffle partition
_REPEATS = 1_000  # equal rows that a task makes at a time
_SCHEMA = "doc_id long, text string, fingerprint string, edited_text string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [*(x.split()[0] for x in _SCHEMA.split(", ")), "times"]


def levels(text: bytes) -> np.ndarray:
    """The entropy level of each window: exact sums of n log n over the counts of its bytes, from one window to the next."""
    data = np.frombuffer(text, np.uint8)
    out = []
    for at in range(0, max(0, len(data) - WINDOW + 1), _STEP):
        part = data[at : at + _STEP + WINDOW - 1]
        ahead, behind = np.ones(len(part), np.uint8), np.ones(len(part), np.uint8)
        for d in range(1, WINDOW):
            same = part[:-d] == part[d:]
            ahead[:-d] += same
            behind[d:] += same
        sums = np.empty(len(part) - WINDOW + 1, np.int64)
        sums[0] = _F[np.bincount(part[:WINDOW])].sum()
        np.cumsum(_G[behind[WINDOW:]] - _G[ahead[: len(sums) - 1]], out=sums[1:])
        sums[1:] += sums[0]
        out.append(((_TOP - sums) * (LEVELS - 1) // _TOP).astype(np.uint8))
    return np.concatenate(out) if out else np.empty(0, np.uint8)


def features(text: bytes, ranks: np.ndarray) -> np.ndarray:
    """Hashes of a text's features in their order: at least one, but for an empty text. A text shorter than a window is one."""
    if len(text) < WINDOW:
        return mix(np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), np.uint64)) if text else np.empty(0, np.uint64)
    keys = (ranks[levels(text)].astype(np.int64) << 40) | np.arange(len(text) - WINDOW + 1)
    if len(keys) <= RUN:
        chosen = keys.min(keepdims=True) & ((1 << 40) - 1)
    else:
        low, width = keys, 1
        while width < RUN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        picked = low & ((1 << 40) - 1)
        begins = np.flatnonzero(np.diff(picked, prepend=-1))
        times = np.diff(begins, append=len(picked))
        if times.max() < PICKED:
            return _once(text, picked[begins][times == times.max()])
        chosen = picked[begins][times >= PICKED]
    return _hashes(text, chosen)


def _hashes(text: bytes, chosen: np.ndarray) -> np.ndarray:
    """A hash of each of the windows that begin at the chosen places."""
    data = np.frombuffer(text, np.uint8)
    parts = np.ascontiguousarray(data[chosen[:, None] + np.arange(WINDOW)]).view(np.uint64)
    out = np.full(len(chosen), WINDOW, np.uint64)
    for k in range(parts.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return out


def _once(text: bytes, chosen: np.ndarray) -> np.ndarray:
    """The distinct hashes of the chosen windows, in their own order, so that equal windows count alike wherever they stand."""
    found = np.empty(0, np.uint64)
    for at in range(0, len(chosen), _STEP):
        found = np.union1d(found, _hashes(text, chosen[at : at + _STEP]))
    return found


class Digest:
    """Chained Bloom filters; size is the number of features."""

    def __init__(self, found: np.ndarray):
        self.size = len(found)
        bits = np.zeros((-(-self.size // FULL), BITS), bool)
        row = np.arange(self.size) // FULL
        for k in range(HASHES):
            bits[row, (found >> np.uint64(11 * k)).astype(np.int64) % BITS] = True
        self.filters = np.packbits(bits, axis=1)
        self.weights = np.bitwise_count(self.filters).sum(axis=1, dtype=np.int64)
        self.sizes = np.minimum(FULL, self.size - FULL * np.arange(len(bits)))

    def __str__(self) -> str:
        return f"{self.size}:{base64.b64encode(self.filters.tobytes()).decode()}"


def likeness(a: Digest, b: Digest) -> float:
    """From 0 to 1. Digests without features are like each other only."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    if a.size > b.size or (a.size == b.size and a.filters.tobytes() > b.filters.tobytes()):
        a, b = b, a
    best = np.zeros(len(a.sizes))
    none = (1 - 1 / BITS) ** HASHES  # the chance that a feature leaves a bit alone
    for at in range(len(b.sizes)):
        common = np.bitwise_count(a.filters & b.filters[at]).sum(axis=1, dtype=np.int64)
        most = np.minimum(a.weights, b.weights[at])
        chance = BITS * (1 - none**a.sizes) * (1 - none ** b.sizes[at])
        low = chance + 0.3 * np.maximum(0, most - chance)
        best = np.maximum(best, np.where(most > low, (common - low) / np.maximum(most - low, 1e-9), 0.0))
    return float(np.clip(best, 0, 1).mean())


def rarity_ranks(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level, the rarest of the corpus first; equally rare levels in their order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                total += np.bincount(levels(text or b""), minlength=LEVELS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["level", "n"])

    sums = np.zeros(LEVELS, np.int64)
    for x in docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        sums[x.level] = x.n
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.argsort(sums, kind="stable")] = np.arange(LEVELS)
    return ranks


def _dealt(keys: np.ndarray, ties: np.ndarray) -> Callable[[Column, Column], Column]:
    """A column function of (key, tie): twice the number of the block that holds it, and 1 more for the first row of a block.

    keys, ties: of the first row of each block, in order. A few numbers for each shuffle partition, searched in numpy.
    """

    @F.pandas_udf("long")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        key, tie = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        block = np.searchsorted(keys, key, "right") - 1
        for k in np.unique(key[keys[block] == key]):
            own = key == k
            first = np.searchsorted(keys, k)
            block[own] = first + np.searchsorted(ties[first : np.searchsorted(keys, k, "right")], tie[own], "right") - 1
        block = np.maximum(block, 0)
        return pd.Series(2 * block + ((keys[block] == key) & (ties[block] == tie)))

    return place


def _in_order(keyed: DataFrame, names: DataFrame) -> DataFrame:
    """block, copy, doc_id, text: each block in order in one partition, followed by a copy of the first row after it.

    keyed: rows with key and tie, which tell them apart; names: key and tie of each.
    """
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = names.repartitionByRange(_BLOCKS * partitions, "key", "tie")
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "tie")).alias("first")).select("first.*").orderBy("key", "tie").toPandas()  # a few for each partition
    at, blocks = _dealt(firsts["key"].to_numpy(np.int64), firsts["tie"].to_numpy(np.int64)), max(1, len(firsts))
    block = F.shiftright("at", 1)
    here, there = F.struct(block.alias("block"), F.lit(0).alias("copy")), F.struct(F.pmod(block - 1, F.lit(blocks)).alias("block"), F.lit(1).alias("copy"))
    places = F.when(F.col("at") % 2 == 1, F.array(here, there)).otherwise(F.array(here))
    placed = keyed.withColumn("at", at(F.col("key"), F.col("tie"))).select(F.explode(places).alias("at"), "doc_id", "text", "key", "tie").select("at.*", "doc_id", "text", "key", "tie")
    return placed.repartition(partitions, "block").sortWithinPartitions("block", "copy", "key", "tie").select("block", "copy", "doc_id", "text")


def _told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The rows, each pair of doc_id and text once, with key and tie; these two of each; and (doc_id, text, n) of the pairs that n > 1 rows have.

    Only rows whose key and tie repeat, found by narrow counts and a bitmap, are grouped by their texts.
    """
    keyed = rows.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    names = cut(keyed.groupBy("key", "tie").agg(F.count("*").alias("n")))
    repeated = names.where("n > 1").select(F.xxhash64("key", "tie").alias("row"))
    if repeated.isEmpty():
        return keyed, names, None
    split = marked(keyed.withColumn("row", F.xxhash64("key", "tie")), repeated, "row", "row")
    grouped = cut(split.where("__near").groupBy("doc_id", "text", "key", "tie").agg(F.count("*").alias("n")))
    return split.where("not __near").select(keyed.columns).unionByName(grouped.select(keyed.columns)), names, grouped.where("n > 1").select("doc_id", "text", "n")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, edited_text, edited_fingerprint, near_edited, near_next for each row of docs.

    The next document is the one of the next doc_id (after the last: the first; a null doc_id comes first, and of rows
    that share one the order is by a hash of the text). edited_text: the last quarter of the code points, rounded down,
    replaced by the first as many (or all) of the next text. A null text is empty. near_edited, near_next: likeness to
    the fingerprints of the edited and of the next text. Other columns are ignored; an empty table gives an empty table.
    """
    rows = texts(docs)
    ranks = rarity_ranks(rows)
    made = lambda text: Digest(features(text.encode(), ranks))

    def judged(doc: int | None, whole: str, own: Digest, following: str, digest: Digest) -> tuple:
        n = len(whole) // 4
        edited = whole[: len(whole) - n] + following[:n]
        other = made(edited) if edited != whole else own
        return doc, whole, str(own), edited, str(other), likeness(own, other), likeness(own, digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # block, doc_id, text and digest of the row before
        for batch in batches:
            out = []
            for block, copy, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if copy and (last is None or last[0] != block):
                    continue
                digest = made(text)
                if last is not None and last[0] == block:
                    out.append(judged(*last[1:], text, digest))
                last = None if copy else (block, doc, text, digest)
            yield _batch(out)

    def run_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = made(text or "")
                out.append((*judged(doc, text or "", digest, text or "", digest), times))
            yield _batch(out, len(_NAMES))

    keyed, names, repeats = _told_apart(rows)
    whole = _in_order(keyed, names).mapInArrow(run, _SCHEMA)
    if repeats is None:
        return whole
    before_last = F.col("n") - 1  # of equal rows all but the last are followed by an equal one
    parts = repeats.select("doc_id", "text", F.explode(F.sequence(F.lit(0), before_last - 1, F.lit(_REPEATS))).alias("first"), before_last.alias("n"))
    dealt = parts.select("doc_id", "text", F.least(F.lit(_REPEATS), F.col("n") - F.col("first")).alias("times")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = dealt.mapInArrow(run_repeats, f"{_SCHEMA}, times long").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return whole.unionByName(each.select(whole.columns))


def _batch(rows: list[tuple], columns: int = len(_NAMES) - 1) -> pa.RecordBatch:
    """Of judged rows, without or with a number of times."""
    kinds = [pa.int64(), *[pa.string()] * 4, pa.float64(), pa.float64(), pa.int64()][:columns]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], _NAMES[: len(kinds)])
