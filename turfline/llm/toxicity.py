"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are runs of letters and digits in lower case (A-Z). A token has its own log-odds or else those of its longest
known prefix of PREFIXES bytes, all named by 64-bit hashes: compounds and inflections are too many to be seen each.
Log-odds between toxic and clean training documents, each of which counts a name once, are smoothed with an
informative Dirichlet prior, the pooled counts scaled to PRIOR times the smaller side; a name counts only if its z-score says that the
difference isn't chance, and every token pays DRIFT, so that random text scores below zero. A linear scan finds every maximal segment of positive score. By Karlin and Altschul's
statistics a segment of score S among n tokens has the normalised score lambda * S - ln(K * n), whose chance values
follow an extreme-value law; lambda comes from the clean tokens' scores, K from the clean documents' best segments.
A document's evidence is its best normalised score and the sum of those of all significant segments; a logistic curve
over both, fitted on the training documents, is its score.

Scale: the model is fitted on at most TRAIN labelled documents, chosen by hash and checkpointed from one scan, and has at
most TOKENS tokens, the most significant ones. Their segments' scores, a row for each of them, reach the driver. Scoring
is one narrow pass over whole texts, each scanned once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.llm import hashing
from turfline.llm.common import cut, sampled_texts, texts

TRAIN, TOKENS, PRIOR, CERTAIN, DRIFT, LOGISTIC_STEPS = 32_768, 1 << 16, 1.0, 3.5, 0.5, 60
PREFIXES = (4, 5, 6, 7, 8)
SIGNIFICANT = 0.05
_FOLDS = 5
_EULER = 0.5772156649015329
_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", *range(0x80, 0x100)]] = True


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of a text in UTF-8 start and end."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = _WORD[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def names(text: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which tokens, their names), for each length of prefix, the shortest first, then for whole tokens."""
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts >= n)
        yield long, hashing.span_hashes(text, starts[long], starts[long] + n, fold=True) ^ np.uint64(n)
    yield np.arange(len(starts)), hashing.span_hashes(text, starts, ends, fold=True)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), left to right, by the linear-time scan of Ruzzo and Tompa."""
    # first, end, the cumulative scores before and at its end, and the last earlier segment that began at a lower one
    found: list[tuple[int, int, float, float, int]] = []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    breaks = np.flatnonzero(np.diff(positive) > 1) + 1
    for run in np.split(positive, breaks):
        first, end = int(run[0]), int(run[-1]) + 1
        low, high = float(sums[first]), float(sums[end])
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= low:
                at = found[at][4]
            if at < 0 or found[at][3] >= high:
                found.append((first, end, low, high, at))
                break
            first, _, low, _, before = found[at]
            del found[at:]
            at = before
    return [(a, z, high - low) for a, z, low, high, _ in found]


@dataclass
class Model:
    """What training gives; a few numbers and two arrays of at most TOKENS entries."""

    keys: np.ndarray
    odds: np.ndarray
    rate: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.first = np.zeros(1 << 16, bool)  # the upper bits of the keys: most names are told apart by them
        self.first[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def token_scores(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), -DRIFT)
        for which, found in names(text, starts, ends):
            maybe = np.flatnonzero(self.first[(found >> np.uint64(48)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(self.keys, found[maybe]), len(self.keys) - 1)
                known = self.keys[at] == found[maybe]
                out[which[maybe[known]]] = self.odds[at[known]] - DRIFT
        return out

    def segments(self, text: bytes) -> tuple[int, list[tuple[int, int, float, float]]]:
        """The number of tokens, and (start, end, score, normalised score) of each maximal segment; start and end in bytes."""
        starts, ends = tokens(text)
        chance = math.log(max(1, len(starts))) + self.log_k
        return len(starts), [(int(starts[a]), int(ends[z - 1]), s, self.rate * s - chance) for a, z, s in maximal_segments(self.token_scores(text, starts, ends))]

    def judge(self, text: bytes) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The score, and (start, end, score, p) of each segment that chance would give with a probability of SIGNIFICANT at most."""
        found = self.segments(text)[1]
        spans = [(a, z, s, -math.expm1(-math.exp(-x))) for a, z, s, x in found]
        return self.score_of(*evidence([x for *_, x in found])), [x for x in spans if x[3] <= SIGNIFICANT]

    def score_of(self, best: float, total: float) -> float:
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * max(-5.0, min(best, 30.0)) + c * total))))


def evidence(normal: list[float]) -> tuple[float, float]:
    """Of a document, from its segments' normalised scores: the best one, and the log of one more than the sum of the significant ones."""
    level = -math.log(-math.log1p(-SIGNIFICANT))
    return max(normal, default=-5.0), math.log1p(sum(x for x in normal if x >= level))


def _token_counts(train: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[np.ndarray] = [np.empty(0, np.uint64)]
            toxic: list[np.ndarray] = [np.empty(0, bool)]
            for text, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(np.concatenate([x for _, x in names(text or b"", *tokens(text or b""))]))
                hashes.append(found)
                toxic.append(np.full(len(found), label == 1))
            keys, where = np.unique(np.concatenate(hashes), return_inverse=True)
            all_, bad = np.bincount(where, minlength=len(keys)), np.bincount(where, np.concatenate(toxic), minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(all_ - bad)], ["token", "toxic", "clean"])

    return train.select("text", "toxic").mapInArrow(count, "token long, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda for which the mean of exp(lambda * score) over clean tokens is 1."""
    low, high = 0.0, 50.0 / max(1.0, float(scores.max()))
    grown = lambda x: float((share * np.exp(x * scores)).sum())
    if grown(high) <= 1:
        return high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if grown(mid) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve with an intercept, by Newton steps with a small ridge; both classes weigh their rows."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(LOGISTIC_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(train: DataFrame) -> Model:
    """A model from a bounded number of rows of text and toxic (0 or 1). Without rows of both labels every document scores below 0.5, and so does a text without segments in any case."""
    counts = _token_counts(train).persist()
    try:
        toxic, clean, kinds = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0)), F.count("*")).first()
        if not toxic or not clean:
            return Model(np.empty(0, np.uint64), np.empty(0), weights=(-5.0, 0.0, 0.0))
        prior = PRIOR * min(toxic, clean)
        share = (F.col("toxic") + F.col("clean")) / F.lit(float(toxic + clean)) * prior
        a, b = F.col("toxic") + share, F.col("clean") + share
        odds = F.log(a / (toxic + prior - a)) - F.log(b / (clean + prior - b))
        rated = counts.withColumn("odds", odds).withColumn("z", F.abs(odds) / F.sqrt(1 / a + 1 / b))
        top = rated.where(F.col("z") >= CERTAIN).orderBy(F.desc("z"), "token").limit(TOKENS).toPandas()
    finally:
        counts.unpersist()
    keys = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], top["odds"].to_numpy(float)[order])
    known = top["clean"].to_numpy(float)[order]
    scores, shares = np.append(model.odds, 0.0) - DRIFT, np.append(known, clean - known.sum()) / clean
    model.rate = _rate(scores, shares)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.segments(x or b"") for x in batch.column(0).cast(pa.binary()).to_pylist()]
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([[s for _, _, s, _ in x] for _, x in found], pa.list_(pa.float64())), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["n", "scores", "toxic"])

    rows = train.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measure, "n long, scores array<double>, toxic int").toArrow().to_pylist()
    calm = [model.rate * max(x["scores"], default=0.0) - math.log(x["n"]) for x in rows if x["toxic"] == 0 and x["n"]]
    model.log_k = sum(calm) / len(calm) - _EULER if calm else 0.0
    normal = [[model.rate * s - math.log(max(1, x["n"])) - model.log_k for s in x["scores"]] for x in rows]
    features = np.array([evidence(x) for x in normal]).reshape(-1, 2).clip([-5, 0], [30, np.inf])
    level, best, total = (float(x) for x in _logistic(features, np.array([x["toxic"] for x in rows], float)))
    model.weights = (min(level, 5 * best - 0.01), best, total)  # a text without any segment is never likelier toxic than not, whatever the labels
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are never learned from: crc32 of its id as text is a multiple of 5. Not for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % _FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> DataFrame:
    """text and toxic of at most `train` labelled documents, the first by hash, outside the held-out fold; a row for each doc_id."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train)
    return cut(sampled_texts(docs, ids).select("text", "toxic"))  # fitting reads it twice


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and segments (start, end in bytes, score, p of each significant one) for each row.

    A null or empty text has no segment and the score of none. Rows that repeat score alike; other columns are ignored.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))
        for batch in batches:
            found = [model.judge(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            spans = [[dict(zip(("start", "end", "score", "p"), s, strict=True)) for s in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "segments"])

    rows = texts(docs).mapInArrow(apply, "doc_id long, score double, segments array<struct<start:long,end:long,score:double,p:double>>")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")


def classify(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> DataFrame:
    """score() of docs by a model fitted on the labelled ones among them."""
    return score(docs, fit(training_rows(docs, labels, train)))


def drop_toxic(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> DataFrame:
    """The rows of docs that stay, with all their columns: those that aren't predicted toxic or have no significant segment, which is no evidence.

    So where labels tell nothing, however many of them are toxic, nothing goes. Decided in the scan, so no text is shuffled.
    """
    model = fit(training_rows(docs, labels, train))
    columns = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in batches:
            found = [model.judge(x or b"") for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array([score < 0.5 or not spans for score, spans in found], pa.bool_()))

    texts(docs)  # for its bound on batches
    return docs.mapInArrow(keep, docs.schema)
