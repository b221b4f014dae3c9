"""Whitening against a dense eigendecomposition of the exact covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.llm import whitening


class InMemory:
    """Stands for the distributed products."""

    def __init__(self, v):
        self.v, self.dimensions, self.passes = v, len(v), 0

    def times(self, q):
        self.passes += 1
        return self.v @ q


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(60, 70, 200),  # flat
        0.8 ** np.arange(300),  # falling fast
        1 / np.arange(1, 400),
        np.concatenate(([1e6], np.full(3, 10.0), np.linspace(1, 2, 150))),  # multiple ones
        np.concatenate((np.linspace(5, 9, 20), np.zeros(100))),  # fewer than wanted that aren't zero
        np.full(90, 4.0),
    ],
)
def test_components_of_many_spectra(values):
    v = spectrum(values)
    data = InMemory((v + v.T) / 2)
    found, vectors = whitening.components(data)
    right = np.sort(np.linalg.eigvalsh(data.v))[::-1]
    real = min(32, int((right > 1e-12 * right[0]).sum()))
    assert len(found) == real
    assert np.allclose(found, right[:real], rtol=1e-9, atol=1e-12 * right[0])
    assert np.abs(data.v @ vectors - vectors * found).max() < 1e-9 * right[0]
    assert np.abs(vectors.T @ vectors - np.eye(real)).max() < 1e-12


def test_lower_bound_is_one():
    data = InMemory(spectrum(np.linspace(3, 50, 120)))
    assert 0 <= whitening._lower_bound(data, np.random.default_rng(1)) <= 3.5


def slow(rows, wanted=32):
    """{vec_id: (deviation, whitened)}, shares, from all rows at once, in whole numbers and numpy's eigh."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    c = (apart / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    real = values > 1e-12 * values[0]
    return [int(d) for d in (apart**2).sum(axis=1)], c @ vectors[:, real] / np.sqrt(values[real]), values[real] / np.trace(c.T @ c / n)


def check(got, rows):
    deviations, whitened, shares = slow(rows)
    k = whitened.shape[1]
    assert len(got) == len(rows) * k
    assert {x.n for x in got} == {len(rows)}
    assert len({x.identity_error for x in got}) == 1 and got[0].identity_error < 1e-9
    mine = np.array([[x.whitened for x in sorted(got, key=lambda x: (x.vec_id is None, x.vec_id, x.component))]]).reshape(len(rows), k)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    theirs = whitened[order]
    assert np.abs(mine - theirs * np.sign((mine * theirs).sum(axis=0))).max() < 1e-7
    assert sorted((x.vec_id, x.deviation) for x in got if x.vec_id is not None and x.component == 1) == sorted((i, d) for (i, _), d in zip(rows, deviations, strict=True) if i is not None)
    for x in got[:k]:
        assert x.explained == pytest.approx(shares[x.component - 1], rel=1e-9)


def test_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whitening.whiten(vectors).collect(), [(x.vec_id, x.embedding) for x in vectors.collect()])


def test_rows_left_out_and_kept(spark):
    rng = np.random.default_rng(5)
    good = [(k if k else None, [float(c) for c in v]) for k, v in enumerate(rng.standard_normal((40, 5)) * [3, 2, 1, 0.5, 0.1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [math.inf, 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [0.0] * 6), (107, [3e38] * 5)]
    rows = bad[:4] + good + bad[4:]
    for kind in ("float", "double"):
        rounded = [(k, [float(np.float32(c)) for c in v]) if kind == "float" else (k, v) for k, v in good]
        docs = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"n": F.lit(1), "component": F.lit("x"), "entries": F.lit(2)})
        check(whitening.whiten(docs.repartition(3)).collect(), rounded)
    assert whitening.whiten(docs.limit(0)).count() == 0
    assert whitening.whiten(docs.where("vec_id = 100")).count() == 0


def test_equal_vectors_and_repeats(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 5.0])]  # a dimension without variance
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((x.vec_id, x.component, x.deviation, round(abs(x.whitened), 9), x.explained) for x in got) == [(1, 1, 256**2, 0.707106781, 1.0)] * 2 + [(2, 1, 512**2, 1.414213562, 1.0)]


def test_deviations_beyond_small_numbers():
    x = np.array([[0, 5], [1 << 40, 7], [3, 1 << 51]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    whole = np.array([s // 3 for s in sums], np.int64)
    exact = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert whitening._deviations(x, 3, sums, whole) == [v if v < 1 << 63 else None for v in exact]
    x = x[:, :1] >> 12
    s = int(x.sum())
    assert whitening._deviations(x, 3, [s], np.array([s // 3])) == [(3 * int(c) - s) ** 2 for c in x[:, 0]]
