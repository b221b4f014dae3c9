"""MinHash near-duplicate detection with circulant permutations, banding and exact Jaccard verification.

Each document is its set of distinct five-word shingles. Two permutations of the 32-bit numbers make all
coordinates: `sigma` scatters the shingles once, `pi` shifted by k gives coordinate k as min(pi(sigma(x) + k)).
BANDS bands of ROWS coordinates put a pair of similarity 0.75 into a common bucket but for once in 180,000 pairs.

Scale: documents with equal sets are one class from the first shuffle on. A bucket is never expanded into all its
pairs. Two classes alone in a bucket are compared; in larger buckets the first and the last are leaders, and each class
meets the LEADERS leaders that it shares most buckets with. Verified edges make components. Only larger buckets that
still hold several components stay open, and for their classes an exact way takes over: ordered by rarity, two sets that
are similar enough share one of their rarest elements, at places that leave enough of both. Each class first meets
the most typical class (the one with the fewest rare elements) that it shares such an element with, then those of
other components. What many documents have in common, a passage or a line, is never rare, so it makes no pair. Nothing
is capped. Of texts only those whose classes share a bucket are shuffled, behind a bitmap of their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.llm import hashing
from turfline.llm.common import cut, likely, texts
from turfline.llm.components import components

WIDTH, PERCENT, BANDS, ROWS, LEADERS = 5, 75, 32, 4, 2
_ROWS = 8_000  # documents for each file of a checkpoint
_STEP = 1024  # shingles whose coordinates are made at a time, to stay in the processor's cache


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles; a text of fewer words is one shingle, one of none is empty."""
    starts, ends = hashing.word_spans(text)
    if not len(starts):
        return np.empty(0, np.uint64)
    words = hashing.span_hashes(text, starts, ends, fold=True)
    return np.unique(hashing.windows(words, min(width, len(words))))


#: Two permutations of the 32-bit numbers, as (shift, odd factor) steps and a last shift.
_SIGMA, _PI = ((16, 0x7FEB352D), (15, 0x846CA68B), 16), ((16, 0x85EBCA6B), (13, 0xC2B2AE35), 16)


def _permuted(x: np.ndarray, permutation: tuple) -> np.ndarray:
    """In place."""
    *steps, last = permutation
    for shift, factor in steps:
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(last)
    return x


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least pi(sigma(x) + k)."""
    sigma = _permuted((found ^ (found >> np.uint64(32))).astype(np.uint32), _SIGMA)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), _STEP):
        np.minimum(out, _permuted(sigma[None, at : at + _STEP] + shifts, _PI).min(axis=1), out=out)
    return out


def _bands(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    made = signature(found, bands * rows).astype(np.uint64).reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = hashing.mix(keys * np.uint64(0x9E3779B97F4A7C15) + made[:, k])
    return keys.view(np.int64)


def _digest(text: str) -> Column:
    """128 bits of a text itself: with the doc_id it names a row, but for rows that repeat both."""
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def _signed(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, contents, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingles(text or b"", width)
                sizes.append(len(found))
                contents.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(_bands(found, bands, rows) if len(found) else None)
            made = [pa.array(sizes, pa.int64()), pa.array(contents, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], ["doc_id", "digest", "n_shingles", "content", "bands"])

    return texts(docs).withColumn("digest", _digest("text")).mapInArrow(sign, "doc_id long, digest binary, n_shingles long, content binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, size, found) of the wanted classes, from the text of each one's representative."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text or b"", width).view(np.int64) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [batch.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["class", "size", "found"])

    near = likely(texts(docs), wanted, "rep").select("doc_id", _digest("text").alias("digest"), "text")
    rows = near.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.coalesce("digest", F.lit(b"")) == F.col("rep_digest")))
    return rows.select("class", "text").mapInArrow(read, "class long, size long, found array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough. Sizes are compared first: sets go only to pairs that they leave."""
    side = lambda x: sets.select(F.col("class").alias(x), F.col("size").alias(f"size_{x}"))
    fit = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(fit)
    whole = lambda x: sets.select(F.col("class").alias(x), F.col("found").alias(f"found_{x}"))
    common = F.size(F.array_intersect("found_a", "found_b")).cast("long")
    similar = 100 * common >= percent * (F.col("size_a") + F.col("size_b") - common)
    return sized.join(whole("a"), "a").join(whole("b"), "b").where(similar).select("a", "b")


def _joined(parts: list[DataFrame], rows: DataFrame, column: str = "class", name: str = "component") -> DataFrame:
    """rows with the component of a class; each of parts leads on from the components of those before it."""
    rows = rows.withColumn(name, F.col(column))
    for part in parts:
        onward = part.select(F.col("node").alias("__node"), F.col("component").alias("__root"))
        rows = rows.join(onward, F.col(name) == F.col("__node"), "left").withColumn(name, F.coalesce("__root", name)).drop("__node", "__root")
    return rows


def _band_pairs(live: DataFrame) -> DataFrame:
    """Of members (key, class, low, high, two): the pairs of buckets of two, and each class with the leaders it meets most often."""
    pair = (F.least("leader", "class").alias("a"), F.greatest("leader", "class").alias("b"))
    twos = live.where("two and class = low").select(F.col("high").alias("leader"), "class")
    met = live.where("not two").select("class", F.explode(F.array("low", "high")).alias("leader")).where("leader != class")
    counts = met.groupBy("class", "leader").agg(F.count("*").alias("n"))  # at most two leaders for each band of a class
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("n", "leader")))), 1, LEADERS)
    chosen = counts.groupBy("class").agg(best.alias("best")).select("class", F.explode("best.leader").alias("leader"))
    return twos.unionByName(chosen.select("leader", "class")).select(*pair).distinct()


def _needed(size_a: str, size_b: str, percent: int) -> Column:
    """The least number of common elements of two similar sets."""
    return F.ceil(F.lit(percent) * (F.col(size_a) + F.col(size_b)) / F.lit(100.0 + percent) - 1e-9)


def _rare_elements(sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(class, size, element, place) of each set's rarest elements that others have, too: as many as a similar set can't miss all.

    The order is by the number of sets that have an element, then by its hash; place counts from 1.
    """
    elements = sets.select("class", "size", F.explode("found").alias("element"))
    shared = cut(elements.groupBy("element").agg(F.count("*").alias("holders")).where("holders > 1"), tasks)  # so that the join with a frequent element is one that AQE splits
    ranked = elements.join(shared, "element", "left").select("class", "size", F.struct(F.coalesce("holders", F.lit(1)).alias("holders"), "element").alias("e"))
    ordered = ranked.groupBy("class", "size").agg(F.array_sort(F.collect_list("e")).alias("es"))  # a document's own elements
    enough = (F.col("size") - F.ceil(F.col("size") * percent / 100.0 - 1e-9) + 1).cast("int")
    placed = ordered.select("class", "size", F.posexplode(F.slice("es", F.lit(1), enough)).alias("at", "e"))
    return placed.where("e.holders > 1").select("class", "size", F.col("e.element").alias("element"), (F.col("at") + 1).cast("long").alias("place"))


def _typical_pairs(rare: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Each class with one of another component: of those at the head of its elements the one with the fewest rarer elements."""
    head = rare.groupBy("element").agg(F.min(F.struct((F.col("place") / F.col("size")).alias("rareness"), F.col("class").alias("leader"), F.col("component").alias("led"))).alias("head"))
    met = rare.join(cut(head, tasks), "element").where("component != head.led")
    one = met.groupBy("class").agg(F.min("head").alias("head")).select("class", F.col("head.leader").alias("leader"))
    return one.select(F.least("leader", "class").alias("a"), F.greatest("leader", "class").alias("b")).distinct()


def _remaining_pairs(rare: DataFrame, percent: int, tasks: int) -> DataFrame:
    """All pairs of different components that share a rare element at places which leave enough elements for both."""
    heads = rare.groupBy("element").agg(F.min("component").alias("from"), F.max("component").alias("to"), F.min(F.struct((F.col("place") / F.col("size")).alias("rareness"), F.col("component").alias("main"))).alias("head"))
    open_ = cut(rare.join(cut(heads.where("from < to").select("element", "head.main"), tasks), "element"), tasks)  # so that AQE splits the next join, too
    names = ("class", "size", "place", "component")
    one = open_.where("component != main").select("element", *[F.col(c).alias(f"{c}_a") for c in names])  # one of two components isn't the head's
    two = open_.select("element", *[F.col(c).alias(f"{c}_b") for c in names])
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + 1
    fit = (F.col("component_a") != F.col("component_b")) & (left >= _needed("size_a", "size_b", percent))
    return one.join(two, "element").where(fit).select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def _grouped(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, digest, n_shingles, component, component_id) for each row of docs with shingles; (doc_id, n_shingles) of the others; files for as many rows."""
    signed = cut(_signed(docs, bands, rows, width))
    tasks = 1 + signed.count() // _ROWS
    filled = signed.where("n_shingles > 0")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("rep")
    classes = filled.groupBy("content").agg(rep, F.first("bands").alias("bands"))
    classes = cut(classes.select("content", F.col("rep.doc_id").alias("rep"), F.col("rep.digest").alias("rep_digest"), "bands", F.monotonically_increasing_id().alias("class")), tasks)
    members = classes.select("class", F.explode("bands").alias("key"))
    ends = members.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), (F.count("*") == 2).alias("two")).where("low < high")
    live = cut(members.join(cut(ends, tasks), "key"), tasks)  # classes that share a bucket with another
    parts: list[DataFrame] = []
    if not live.isEmpty():
        wanted = cut(live.select("class").distinct().join(classes.select("class", "rep", "rep_digest"), "class"), tasks)
        sets = cut(_sets(docs, wanted, width), tasks)
        if sets.count() > wanted.count():  # rows that repeat both doc_id and text
            sets = cut(sets.dropDuplicates(["class"]), tasks)
        parts.append(cut(components(_verified(_band_pairs(live), sets, percent), tasks), tasks))
        open_keys = _joined(parts, live.where("not two")).groupBy("key").agg(F.min("component").alias("from"), F.max("component").alias("to")).where("from < to")
        rest = live.where("not two").join(cut(open_keys, tasks), "key").select("class").distinct()
        rare = cut(_rare_elements(sets.join(rest, "class", "left_semi"), percent, tasks), tasks)
        if not rare.isEmpty():
            for pairs in (_typical_pairs, _remaining_pairs):
                found = cut(_verified(pairs(cut(_joined(parts, rare), tasks), percent, tasks), sets, percent), tasks)
                if not found.isEmpty():
                    ends = _joined(parts, _joined(parts, found, "a", "from"), "b", "to")
                    parts.append(cut(components(ends.select(F.col("from").alias("a"), F.col("to").alias("b")), tasks), tasks))
    labelled = _joined(parts, classes.select("class", "content", "rep"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = labelled.join(least, "component").select("content", "component", "component_id")
    out = filled.select("doc_id", "digest", "n_shingles", "content").join(named, "content").drop("content")
    return out, signed.where("n_shingles = 0").select("doc_id", "n_shingles"), tasks


def near_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept. options: width, percent, bands, rows.

    component_id is the smallest doc_id that links reach, its own included; kept tells whether the row is the one
    that stays. Null, empty and all-blank texts have no shingles, link to nothing and stay. Rows that repeat a doc_id
    get a row each. A null doc_id never is a component_id unless all of its component's are null. Other columns of
    docs are ignored; an empty table gives an empty table.
    """
    linked, alone, _ = _grouped(docs, **options)
    out = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone.withColumn("component_id", F.col("doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs that stay: one of each group of near copies, with all its columns, whatever their names, and all rows without shingles.

    Rows are told apart by doc_id and text, so null or shared ids lose no text: of a group the row of the least doc_id
    (null comes last) and digest stays. Rows that repeat both are copies, of which one stays.
    """
    own = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(own)])  # no other name can meet a helper's
    linked, _, tasks = _grouped(docs, **options)
    rows = linked.groupBy("component", "doc_id", "digest").agg((F.count("*") > 1).alias("many"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "many")).alias("least")
    stay = cut(rows.groupBy("component").agg(least).select(*[F.col(f"least.{c}").alias(f"__{c}") for c in ("doc_id", "digest", "many")]), tasks)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (_digest("text") == F.col("__digest"))
    blank = docs.where(~F.coalesce(F.col("text").cast("string").rlike("[^ \\t-\\r]"), F.lit(False)))
    out = docs.join(stay.where("not __many"), same, "left_semi").unionByName(blank)
    many = stay.where("__many")
    if many.isEmpty():
        return out.toDF(*own)
    copies = docs.join(many, same).dropDuplicates(["__doc_id", "__digest"])
    return out.unionByName(copies.drop("__doc_id", "__digest", "__many")).toDF(*own)
