"""Quality rules and a hashed n-gram likelihood ratio of trusted text against the raw corpus.

Base rules count words, symbols, repeated lines and repeated three-word windows of a whole text. For the verdict, each
run of GRAM bytes falls into one of BUCKETS hashed buckets. The buckets of all documents are counted, and those of all
trusted ones; the log ratio of the two smoothed multinomials is a table of BUCKETS numbers, and a
document's score is the mean of its runs' entries. The threshold is where all trusted and all distrusted documents part best,
the trusted ones scored as if they weren't in the target themselves.

Scale: two narrow scans, and a merge join with the trusted ids, which shuffles the texts that a bitmap of fixed size leaves;
at no size are these ids broadcast. Tasks hand on a row for each bucket they met; only BUCKETS sums reach the driver. The
second scan leaves a checkpoint of numbers, no texts; the labels are joined to it, and the threshold comes from a range
partitioning of the distinct scores and sums over its ranges, a row for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline.llm import hashing
from turfline.llm.common import cut, likely, marked, texts

GRAM, BUCKETS = 4, 1 << 20
MIN_WORDS, REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STEP = 1 << 20
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = hashing.word_spans(text)
    chars = int(((data & 0xC0) != 0x80).sum() - hashing.SPACE[data].sum())
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    covered = 0
    if len(starts) >= 3:
        _, where, counts = np.unique(hashing.windows(hashing.span_hashes(text, starts, ends), 3), return_inverse=True, return_counts=True)
        again = counts[where] > 1
        marked = np.zeros(len(starts), bool)
        for k in range(3):
            marked[k : k + len(again)] |= again
        covered = int(marked.sum())
    return len(starts), chars, int(_SYMBOL[data].sum()), repeated, covered


def grams(text: bytes, at: int = 0) -> np.ndarray:
    """The buckets of the runs of bytes that begin in one step of a text."""
    data = np.frombuffer(text, np.uint8)[at : at + _STEP + GRAM - 1].astype(np.uint32)
    n = max(0, len(data) - GRAM + 1)
    packed = np.zeros(n, np.uint32)
    for k in range(GRAM):
        packed = (packed << np.uint32(8)) | data[k : k + n]
    return (packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _counted(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                for at in range(0, len(text or b""), _STEP):
                    held.append(grams(text, at))
                    size += len(held[-1])
                    if size > _STEP:
                        total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def counted(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in the target and in all of docs.

    docs: doc_id and text; trusted: the doc_ids, each once, of all documents that make the target.
    """
    return _counted(likely(docs, trusted).join(trusted.hint("merge"), "doc_id", "left_semi")), _counted(docs)


def ratio_table(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The log of target against raw probability of each bucket, both smoothed with one run in all buckets."""
    smooth = lambda x: np.log((x + 1 / BUCKETS) / (x.sum() + 1))
    return smooth(target) - smooth(raw)


def score_unless_trusted(text: bytes, target: np.ndarray, table: np.ndarray) -> float:
    """What score() would give a trusted text if it weren't in the target, as texts that nobody labelled aren't: for thresholds, which its own runs would bias."""
    found = [np.unique(grams(text, at), return_counts=True) for at in range(0, len(text), _STEP)]
    if not found:
        return 0.0
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    own = np.bincount(where, np.concatenate([c for _, c in found]), minlength=len(keys))
    size = target.sum()
    lost = np.log((target[keys] + 1 / BUCKETS) / (np.maximum(target[keys] - own, 0) + 1 / BUCKETS)) - math.log((size + 1) / (max(0.0, size - own.sum()) + 1))
    return float((own * (table[keys] - lost)).sum()) / max(1, len(text) - GRAM + 1)


def score(text: bytes, table: np.ndarray) -> float:
    """The mean entry of a text's runs; 0 where it has none."""
    total = sum(float(table[grams(text, at)].sum()) for at in range(0, len(text), _STEP))
    return total / max(1, len(text) - GRAM + 1)


def _threshold(scores: DataFrame) -> float:
    """The middle of the widest gap among the cuts that part trusted from other scores best; without both, below all trusted ones.

    scores: ratio and trusted. A cut's worth is the share of trusted scores above it plus that of the others below, compared in whole numbers.
    """
    points = scores.groupBy("ratio").agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad"))
    dealt = cut(points.repartitionByRange("ratio").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))
    ranges = sorted(parts.collect(), key=lambda x: x.least)
    good, bad = sum(x.good for x in ranges), sum(x.bad for x in ranges)
    if not good or not bad:
        return ranges[0].least - 1e-9 if good else -math.inf
    starts, good_before, bad_before, last = [], 0, 0, None
    for x in ranges:
        starts.append((x.part, good_before, bad_before, last))
        good_before, bad_before, last = good_before + x.good, bad_before + x.bad, x.most
    begun = scores.sparkSession.createDataFrame(starts, "part int, good_before long, bad_before long, last double")
    inside = Window.partitionBy("part").orderBy("ratio")
    below = lambda c: (F.col(f"{c}_before") + F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("decimal(19,0)")
    worth = below("bad") * F.lit(good).cast("decimal(19,0)") - below("good") * F.lit(bad).cast("decimal(19,0)")
    cuts = dealt.join(F.broadcast(begun), "part").select("ratio", worth.alias("worth"), F.coalesce(F.lag("ratio").over(inside), "last").alias("last"))
    order = F.struct("worth", F.coalesce(F.col("ratio") - F.col("last"), F.lit(0.0)), -F.col("ratio"))
    best = cuts.agg(F.max_by(F.struct("ratio", "last"), order).alias("best")).first().best
    if best.last is None:
        return best.ratio - 1e-9
    middle = (best.ratio + best.last) / 2
    return middle if middle > best.last else best.ratio  # neighbouring doubles have no middle


def judge(docs: DataFrame, labels: DataFrame, labelled: int | None = None) -> DataFrame:
    """doc_id, the five base counts, base_failed, ratio (the length-normalised log likelihood ratio) and kept for each row.

    labels: doc_id and quality (1: trusted, 0: not, others ignored). The target multinomial counts all trusted documents,
    the raw one all documents; all rows of all labelled ids teach the threshold (labelled: only the first so many ids of
    each kind, by hash). Documents that fail a base rule teach neither side of the threshold. A null or empty text has zero
    counts and fails the base rules. Rows that repeat are judged alike; without labels, nothing but the base rules rejects.
    Other columns are ignored.
    """
    known = cut(labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")))
    trusted = known.where("quality = 1").select("doc_id")
    rows = texts(docs)
    target, raw = counted(rows, trusted)
    table = ratio_table(target, raw)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, near in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("near").to_pylist(), strict=True):
                text = text or b""
                counts = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEAT_PERCENT * counts[0]
                out.append((*counts, score(text, table), failed, score_unless_trusted(text, target, table) if near and not failed else None))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate([*[pa.int64()] * 5, pa.float64(), pa.bool_(), pa.float64()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    columns = f"{_BASE}, ratio double, base_failed boolean"
    names = ["doc_id", *[x.split()[0] for x in f"{columns}, apart double".split(", ")]]
    # near: true for all trusted rows and few others; apart: what such a row scores if it is trusted
    scored = cut(marked(rows, trusted, mark="near").mapInArrow(apply, f"doc_id long, {columns}, apart double"))

    taught = known
    if labelled is not None:
        first = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled) for q in (0, 1)]
        taught = first[0].unionByName(first[1])
    seen = scored.where("not base_failed").join(taught.hint("merge"), "doc_id")
    good = F.col("quality") == 1
    low = _threshold(seen.select(F.when(good, F.col("apart")).otherwise(F.col("ratio")).alias("ratio"), good.alias("trusted")))
    return scored.select(*names[:-1], (~F.col("base_failed") & (F.col("ratio") >= F.lit(low))).alias("kept"))
