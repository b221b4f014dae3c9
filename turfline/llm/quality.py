"""Document quality by hierarchical empirical Bayes.

A logistic classifier over counts of a text gives each document's evidence, the probability that it is good. Sums of
evidence by path and by host estimate how good a site is: a host's mean shrinks towards the global mean and a path's
towards its host's, by prior strengths that the spread of the means between sites tells (method of moments). A
document's posterior adds to the log-odds of its evidence those of its path's mean against the global one; its own
evidence is taken out of the sums before.

Scale: one scan makes a short row of counts for each document; the classifier is trained on all labelled ones by
distributed gradients. Sites are grouped with partial sums, so that one with a third of all rows is as cheap as others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.llm import hashing, rules
from turfline.llm.common import bound_batches, cut

THRESHOLD = 0.5
SMALL_TABLE = 20_000  # sites up to which their table is broadcast
_WEAKEST, _STRONGEST = 1.0, 1e4
_UPPER, _LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK[list(b"!?")] = True


def counts_of(text: bytes) -> list[float]:
    """Shares of symbols, capitals, marks, repeated lines and words, distinct words, and logs of lengths."""
    n, chars, symbols, lines, repeats = rules.base_counts(text)
    data = np.frombuffer(text, np.uint8)
    starts, ends = hashing.word_spans(text)
    distinct = len(np.unique(hashing.span_hashes(text, starts, ends, fold=True)))
    words, letters = max(1, n), max(1, int(_LETTER[data].sum()))
    return [
        symbols / max(1, chars),
        min(1.0, 5 * symbols / max(1, chars)),
        _UPPER[data].sum() / letters,
        _MARK[data].sum() / max(1, chars),
        lines / (1 + text.count(b"\n")),
        repeats / words,
        distinct / words,
        float(np.log1p(n)),
        chars / words,
    ]


_N = len(counts_of(b""))


def _with_counts(rows: DataFrame) -> DataFrame:
    """rows with a last column __x, the counts of their text."""
    bound_batches(rows.sparkSession)
    at = rows.columns.index("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(x or b"") for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, "__x"])

    return rows.mapInArrow(count, rows.withColumn("__x", F.array(F.lit(0.0))).schema)


@dataclass
class Evidence:
    """The logistic classifier: an intercept and a weight for each count."""

    intercept: float
    weights: tuple[float, ...]

    def of(self, x: Column) -> Column:
        total = F.lit(self.intercept)
        for k, w in enumerate(self.weights):
            total = total + F.lit(w) * x[k]
        return 1 / (1 + F.exp(-total))


def fit(counted: DataFrame, labels: DataFrame) -> Evidence:
    """From doc_id and __x, and doc_id and quality (0 or 1; others ignored). Without both labels all evidence is 0.5."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("__label"))
    taught = counted.join(known, "doc_id").select(array_to_vector("__x").alias("__features"), "__label").persist()
    try:
        if taught.select("__label").distinct().count() < 2:
            return Evidence(0.0, (0.0,) * _N)
        model = LogisticRegression(featuresCol="__features", labelCol="__label", regParam=1e-3, maxIter=50).fit(taught)
    finally:
        taught.unpersist()
    return Evidence(float(model.intercept), tuple(float(w) for w in model.coefficients))


def _strength(groups: DataFrame, mean: Column, n: Column, total: Column) -> float:
    """Of the prior: from the weighted variance of group means around the mean above them, less what sampling explains."""
    rate = total / n
    spread, noise = groups.agg(F.sum(n * (rate - mean) * (rate - mean)) / F.sum(n), F.sum(rate * (1 - rate)) / F.sum(n)).first()
    level = groups.agg(F.sum(total) / F.sum(n)).first()[0]
    if spread is None or level is None:
        return _STRONGEST
    between = max(1e-9, spread - (noise or 0.0))
    return float(min(_STRONGEST, max(_WEAKEST, level * (1 - level) / between - 1)))


@dataclass
class Sites:
    """paths: __host, __path, __n, __sum, __host_n, __host_sum; the global mean and both prior strengths."""

    paths: DataFrame
    mean: float
    host_strength: float
    path_strength: float


def sites_of(rows: DataFrame) -> Sites:
    """From rows with __host, __path and __evidence."""
    paths = rows.groupBy("__host", "__path").agg(F.count("*").alias("__n"), F.sum("__evidence").alias("__sum"))
    hosts = paths.groupBy("__host").agg(F.sum("__n").alias("__host_n"), F.sum("__sum").alias("__host_sum"))
    joined = cut(paths.join(hosts, "__host"))
    hosts = joined.groupBy("__host").agg(F.first("__host_n").alias("__host_n"), F.first("__host_sum").alias("__host_sum"))
    mean = joined.agg(F.sum("__sum") / F.sum("__n")).first()[0]
    mean = min(1 - 1e-6, max(1e-6, 0.5 if mean is None else mean))
    host_strength = _strength(hosts, F.lit(mean), F.col("__host_n"), F.col("__host_sum"))
    path_strength = _strength(joined, F.col("__host_sum") / F.col("__host_n"), F.col("__n"), F.col("__sum"))
    return Sites(joined, mean, host_strength, path_strength)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(p, F.lit(1 - 1e-9)))
    return F.log(p / (1 - p))


def _posterior(rows: DataFrame, sites: Sites) -> DataFrame:
    """rows with __evidence and the columns __host_mean, __path_mean and __score."""
    paths = sites.paths
    if paths.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:
        paths = F.broadcast(paths)
    p = F.col("__evidence")
    host = (F.col("__host_sum") - p + sites.host_strength * sites.mean) / (F.col("__host_n") - 1 + sites.host_strength)
    joined = rows.join(paths, ["__host", "__path"]).withColumn("__host_mean", host)
    path = (F.col("__sum") - p + sites.path_strength * F.col("__host_mean")) / (F.col("__n") - 1 + sites.path_strength)
    joined = joined.withColumn("__path_mean", path)
    return joined.withColumn("__score", 1 / (1 + F.exp(-(_logit(p) + _logit(F.col("__path_mean")) - F.lit(float(np.log(sites.mean / (1 - sites.mean))))))))


def _site(docs: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in docs.columns else F.lit("")


def _learned(docs: DataFrame, labels: DataFrame, host: str, path: str) -> tuple[Evidence, Sites, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _site(docs, host).alias("__host"), _site(docs, path).alias("__path"), "text")
    counted = cut(_with_counts(rows).drop("text"))
    evidence = fit(counted, labels)
    judged = counted.withColumn("__evidence", evidence.of(F.col("__x"))).drop("__x")
    return evidence, sites_of(judged), judged


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, evidence, host_mean, path_mean, score and kept (score >= threshold) for each row of docs.

    host and path name the columns that tell a document's site and its part of it; a null, or a column that isn't
    there, counts as an empty name. A null or empty text has the evidence of its zero counts. Rows that repeat are
    judged alike; without labels of both kinds everything is kept at the default threshold.
    """
    _, sites, judged = _learned(docs, labels, host, path)
    names = {"__evidence": "evidence", "__host_mean": "host_mean", "__path_mean": "path_mean", "__score": "score"}
    return _posterior(judged, sites).select("doc_id", *[F.col(a).alias(b) for a, b in names.items()], (F.col("__score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, whatever their names.

    Texts are read a second time instead of being shuffled, up to SMALL_TABLE sites. With more their table isn't broadcast: rows then
    meet it in a merge join on the site, whose large partitions AQE splits, since the table is a checkpoint.
    """
    evidence, sites, _ = _learned(docs, labels, host, path)
    own = docs.columns
    named = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(own)])  # no name of docs can meet a helper's
    site = lambda name: F.coalesce(F.col(f"c{own.index(name)}").cast("string"), F.lit("")) if name in own else F.lit("")
    rows = _with_counts(named.withColumns({"__host": site(host), "__path": site(path)}))
    judged = rows.withColumn("__evidence", evidence.of(F.col("__x"))).drop("__x")
    return _posterior(judged, sites).where(F.col("__score") >= threshold).select(*named.columns).toDF(*own)
