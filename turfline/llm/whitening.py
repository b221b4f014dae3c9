"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers, so counts, sums and deviations are exact. The covariance V of all vectors is never built:
each pass over the data multiplies it with a block of columns, as the sum over tasks of C'(CQ) with C the centred
vectors of a task. A few Lanczos steps bound the spectrum from below. Then each round applies a Chebyshev polynomial of
V to a block of the wanted components and GUARD more, by its three-term recurrence, a pass for each degree: between the
lower bound and the block's least Ritz value the polynomial stays small, above it grows fast. QR and Rayleigh-Ritz follow,
with another pass, which also gives the residuals. Rounds stop when those of all wanted components are certified. Where the block would be as wide as the vectors, the first Rayleigh-Ritz is exact.

Scale: vectors are written once, as blocks of at most ROWS rows of bytes in the shared folder; a pass reads them, holds one
block at a time and shuffles one matrix of dimensions x columns for each task, summed in FAN groups before the driver adds
those. What the driver holds depends on the dimensions alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm.common import bound_batches, cut

COMPONENTS, GUARD, DEGREE, ROUNDS, LANCZOS = 32, 16, 10, 60, 12
SPREAD = 1e8
CERTIFIED, ROUNDING = 1e-13, 1e-14  # residuals that are certified: of the own eigenvalue, or of the largest one
RESIDUAL = 1e-9  # of the largest one: the most that rounds may end with where rounding hinders more
SCALE = 64
ROWS, FAN = 4096, 16
_LARGEST = 2.0**52  # an entry beyond it has no exact whole number
_BLOCK = "dimensions long, n long, ids array<long>, entries binary"
_OUT = "vec_id long, deviation long, whitened array<double>"


def _blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of the vectors without null or non-finite entries: entries are floor(SCALE * c), one row after the other as little-endian 64-bit numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, lists = (c.slice(at, ROWS) for c in batch.columns)
                sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
                for d in np.unique(sizes[sizes > 0]).tolist():
                    own = lists.filter(pa.array((sizes == d) & lists.is_valid().to_numpy(zero_copy_only=False)))
                    c = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)  # null: nan
                    whole = np.floor(SCALE * c)
                    good = np.isfinite(c).all(axis=1) & (np.abs(whole) < _LARGEST).all(axis=1)
                    if good.any():
                        named = ids.filter(pa.array(sizes == d)).filter(pa.array(good))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d]), pa.array([int(good.sum())]), pa.array([named.to_pylist()], pa.list_(pa.int64())), pa.array([whole[good].astype("<i8").tobytes()], pa.binary())], ["dimensions", "n", "ids", "entries"]
                        )

    bound_batches(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(read, _BLOCK)


@dataclass(frozen=True)
class _Centre:
    """S/n in each dimension, as a whole number and the part below 1."""

    whole: np.ndarray
    part: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, without the rounding that subtracting a long mean would give."""
        return (x - self.whole).astype(np.float64) - self.part


class _Data:
    """Blocks of one dimension, their exact sums, and sums over all of them of what a block gives."""

    def __init__(self, blocks: DataFrame, dimensions: int, n: int):
        self.blocks, self.dimensions, self.n, self.centre = blocks, dimensions, n, None
        halves = self._summed(lambda x: np.stack(((x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0))))  # neither half's sum leaves 64 bits below 2**36 vectors
        self.sums = [(int(high) << 26) + int(low) for high, low in halves.T]
        whole, rest = zip(*(divmod(s, n) for s in self.sums), strict=True)
        self.centre = _Centre(np.array(whole, np.int64), np.array([r / n for r in rest]))

    def _summed(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of of(x), a matrix, over the blocks x, centred once the mean is known and whole numbers before: in a task, in FAN groups of tasks, then here."""
        d, centre, kind = self.dimensions, self.centre, np.float64 if self.centre else np.int64

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for entries in batch.column(0):
                    x = np.frombuffer(entries.as_buffer(), "<i8").reshape(-1, d)
                    made = of(centre(x) if centre else x)
                    total = made if total is None else total + made
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FAN]), pa.array([total.shape[0]]), pa.array([total.tobytes()], pa.binary())], ["part", "rows", "total"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, kind) for x in table.column("total").to_pylist())
            return pa.table({"rows": table.column("rows").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

        parts = self.blocks.select("entries").mapInArrow(run, "part long, rows long, total binary").groupBy("part").applyInArrow(add, "rows long, total binary").collect()
        return sum(np.frombuffer(x["total"], kind).reshape(x["rows"], -1) for x in parts)

    def times(self, q: np.ndarray) -> np.ndarray:
        """VQ, a pass over the data."""
        return self._summed(lambda c: c.T @ (c @ q)) / self.n

    def variance(self) -> float:
        """The trace of V."""
        return float(self._summed(lambda c: (c * c).sum(keepdims=True))[0, 0]) / self.n


def _lower_bound(data: _Data, rng: np.random.Generator) -> float:
    """About the least eigenvalue, from below, by Lanczos steps with full orthogonalisation. No proof: components() notices where it is too high."""
    q = rng.standard_normal((data.dimensions, 1))
    basis, alpha, beta = q / np.linalg.norm(q), [], []
    for _ in range(min(LANCZOS, data.dimensions - 1)):
        v = data.times(basis[:, -1:])
        alpha.append(float(basis[:, -1] @ v[:, 0]))
        for _ in range(2):
            v -= basis @ (basis.T @ v)
        beta.append(float(np.linalg.norm(v)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        basis = np.hstack((basis, v / beta[-1]))
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
    return max(0.0, float(values[0] - beta[len(alpha) - 1] * abs(vectors[-1, 0])))


def _ritz(data: _Data, block: np.ndarray, locked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors and the norms of their residuals, from QR beside the locked vectors and one pass."""
    for _ in range(2):
        block, _ = np.linalg.qr(block - locked @ (locked.T @ block))
    product = data.times(block)
    small = block.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = block @ turn
    return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0)


def _degree(low: float, high: float, top: float, last: float, most: int) -> int:
    """The largest degree up to most for which the polynomial at top is at most SPREAD times that at the last wanted value, so that QR can still tell the columns apart."""
    grown = [math.log(t + math.sqrt(t * t - 1)) for t in (max(1.0, (2 * x - high - low) / (high - low)) for x in (top, last))]
    apart = grown[0] - grown[1]
    return most if apart * most <= math.log(SPREAD) else max(1, int(math.log(SPREAD) / apart))


def _filtered(product: Callable[[np.ndarray], np.ndarray], block: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times the block: bounded between low and high, scaled to stay near 1 at top."""
    half, middle = (high - low) / 2, (high + low) / 2
    scale = half / (top - middle)
    first, before = scale, block
    now = (product(block) - middle * block) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (product(now) - middle * now) * (2 * following / half) - scale * following * before
        scale = following
    return now


def components(data: _Data, wanted: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues of V that aren't zero, falling, and their unit eigenvectors as columns.

    The first ones that are certified are locked: they leave the block, and for the filter V has the interval's middle
    in their place, so that a few large eigenvalues don't hold up the others.
    """
    rng = np.random.default_rng(7)
    d = data.dimensions
    width, wanted = min(d, wanted + guard), min(d, wanted)
    locked, kept = np.empty((d, 0)), np.empty(0)
    values, vectors, residuals = _ritz(data, np.eye(d) if width == d else rng.standard_normal((d, width)), locked)
    if width < d and values[0] > 0:
        low, best, waited = _lower_bound(data, rng), np.inf, 0
        for _ in range(ROUNDS):
            largest = max([values[0], *kept])
            if values[-1] <= low:
                low = 0.0  # it was none: had the filter let a smaller eigenvalue grow, it would show here
            high = max(values[-1], low + 1e-9 * (values[0] - low))
            if high >= values[0] - 1e-15 * largest:
                break  # all that is left is alike
            most = _degree(low, high, values[0], values[wanted - len(kept) - 1], degree)
            shift, middle = locked * (kept - (low + high) / 2), locked.T
            block = _filtered(lambda q, a=shift, b=middle: data.times(q) - a @ (b @ q), vectors, low, high, values[0], most)
            values, vectors, residuals = _ritz(data, block, locked)
            largest = max([values[0], *kept])
            off = (residuals / np.maximum(CERTIFIED * np.abs(values), ROUNDING * largest))[: wanted - len(kept)]
            done = int(np.argmax(off > 1)) if (off > 1).any() else len(off)
            if done == len(off) and values[-1] >= low - 1e-12 * largest:
                break
            best, waited = (off.max(), 0) if off.max() < best / 2 or done else (best, waited + 1)
            if waited == 4:  # as near as rounding lets it come
                break
            done = min(done, len(off) - 1)
            locked, kept = np.hstack((locked, vectors[:, :done])), np.append(kept, values[:done])
            values, vectors, residuals = values[done:], vectors[:, done:], residuals[done:]
        left = wanted - len(kept)
        if (residuals[:left] > RESIDUAL * max([values[0], *kept])).any():
            raise RuntimeError(f"components aren't certified after {ROUNDS} rounds")
    values, vectors = np.append(kept, values)[:wanted], np.hstack((locked, vectors))[:, :wanted]
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    real = int((values > 1e-12 * values[0]).sum()) if values[0] > 0 else 0
    return values[:real], vectors[:, :real]


def _deviations(x: np.ndarray, n: int, sums: list[int], whole: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n*x - S)**2 for each row, exact; null where it is no 64-bit number."""
    rest = np.array([s - n * int(w) for s, w in zip(sums, whole, strict=True)], np.int64)
    apart = x - whole
    if (np.abs(apart).max(initial=0) + 1.0) * n * np.sqrt(x.shape[1]) < 2.0**31.5:
        return ((n * apart - rest) ** 2).sum(axis=1).tolist()
    exact = ((apart.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> DataFrame:
    """A row for each remaining row of vectors (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, holds a null or non-finite entry or one beyond 2**52 / SCALE, or has another length
    than most (of equally frequent lengths the largest counts) are left out. x: floor(64 * c) + 1000000 for each entry c; the constant drops out of everything returned, so it is never added. n: vectors;
    deviation: the sum over dimensions of (n*x - S)**2 with S the sums, null beyond 64 bits; whitened: the centred vector on the
    component, over the root of its eigenvalue; explained: the eigenvalue's share; identity_error: of the whitened
    vectors' covariance against the identity, measured over all of them. Components of eigenvalue zero don't count, so equal vectors,
    or an empty table, give no row. Rows that repeat, or a null vec_id, count and come through like others; other columns are ignored.
    """
    made = cut(_blocks(vectors))
    sizes = made.groupBy("dimensions").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dimensions")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    data = _Data(made.where(F.col("dimensions") == sizes["dimensions"]), sizes["dimensions"], sizes["n"])
    values, found = components(data, wanted, guard, degree)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    turn, n, sums, d, centre = found / np.sqrt(values), data.n, data.sums, data.dimensions, data.centre
    gram = data._summed(lambda c: np.vstack(((w := c @ turn).T @ w, w.sum(axis=0)))) / n
    error = float(np.abs(gram[:-1] - np.outer(gram[-1], gram[-1]) - np.eye(len(values))).max())
    shares = values / data.variance()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, entries in zip(batch.column(0), batch.column(1), strict=True):
                x = np.frombuffer(entries.as_buffer(), "<i8").reshape(-1, d)
                w = centre(x) @ turn
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(_deviations(x, n, sums, centre.whole), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    rows = data.blocks.select("ids", "entries").mapInArrow(apply, _OUT).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, shares.tolist())), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
