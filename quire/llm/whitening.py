"""Operator 11, embedding whitening by contour integration (FEAST).

The covariance of the distinct quantised vectors is summed by Spark. Its
leading eigenvectors come from a quadrature of the spectral projector: for
points z on a circle around the wanted interval, (z I - V) Y = X is solved
for a block Y, one Spark task for each point; the weighted sum lies in the
eigenspace of the interval. Rayleigh-Ritz on that block gives values and
vectors, which start the next round. Inertia counts (signs of the pivots of
V - s I) place the interval and verify that no eigenvalue in it is missed.

The driver holds what the dimension bounds: V, sums and blocks of vectors.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import packed, quoted, ready, row_ddl, unpacked, written

COMPONENTS = 4
SCALE = 256
#: Points on the upper half of the circle.
POINTS = 8
MAX_ROUNDS = 30
RESULTS = ["n", "deviation", "whitened", "explained", "identity_error"]


# ------------------------------------------------------------------ sums over the fit list
def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column))


def _summed(df: DataFrame, size: int, add) -> np.ndarray:
    """The sum over all rows of ``add(x)`` (``size`` doubles for a matrix of
    rows): one row for each task, summed by Spark."""
    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += add(_matrix(b.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])
    sums = df.select("x").mapInArrow(run, "part array<double>").agg(Summarizer.sum(array_to_vector("part")).alias("s"))
    return np.array(sums.select(vector_to_array("s")).first()[0] or [0.0] * size)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the sums by dimension, as integers."""
    def run(batches):
        n, total = 0, 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                safe = int(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 1 << 62
                n, total = n + len(x), total + x.sum(axis=0, dtype=np.int64 if safe else object).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()),
                                              pa.array([Decimal(int(v)) for v in (n, *total)], pa.decimal128(38, 0))], ["dim", "s"])
    rows = fit.select("x").mapInArrow(run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    got = {r["dim"]: int(r["s"]) for r in rows}
    return got.get(-1, 0), [got[i] for i in range(len(got) - 1)]


# ------------------------------------------------------------------ eigenvalues of an interval
def inertia(a: np.ndarray) -> int:
    """The number of positive eigenvalues of a symmetric matrix: the positive
    pivots of its symmetric elimination (Sylvester). Pivots are the largest
    diagonal entry or, where that is small, the 2 x 2 block of the largest
    entry, which has one positive and one negative eigenvalue."""
    a = a.copy()
    positive = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        i, (r, s) = int(diagonal.argmax()), np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[i] == 0 and off[r, s] == 0:
            return positive
        pivot = [i] if diagonal[i] >= 0.64 * off[r, s] else [int(r), int(s)]
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        positive += 1 if len(pivot) == 2 else int(a[i, i] > 0)
        below = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - below @ np.linalg.solve(a[np.ix_(pivot, pivot)], below.T)
        a = (a + a.T) / 2
    return positive


def interval(v: np.ndarray, k: int) -> tuple[float, float, int]:
    """(low, high, m): the m eigenvalues above ``low``, below ``high``, are
    the k largest and what is equal to the last of them, at most the positive
    ones. Placed by inertia counts alone, in the gap below the last value."""
    eye = np.eye(len(v))
    above = lambda s: inertia(v - s * eye)
    high = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    floor = high * len(v) * 1e-15
    k = min(k, above(floor)) if high > 0 else 0
    if k == 0:
        return 0.0, high, 0

    def edge(count: int, least: float) -> tuple[float, float]:
        """Bounds around the largest s with ``count`` eigenvalues above it."""
        low, top = least, high
        while top - low > 1e-13 * high:
            mid = (low + top) / 2
            low, top = (mid, top) if above(mid) >= count else (low, mid)
        return low, top
    last = edge(k, floor)[0]
    m = above(last)
    following = edge(m + 1, floor)[1] if above(floor) > m else floor
    return (last + min(following, last)) / 2, high, m


def _projected(spark: SparkSession, v: np.ndarray, y: np.ndarray, low: float, high: float, points: int) -> np.ndarray:
    """The quadrature of the projector of (low, high) applied to ``y``: one
    complex shifted solve for each point, each in its own Spark task."""
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(points)

    def run(batches):
        for b in batches:
            for j in b.column("id").to_pylist():
                turn = np.exp(0.5j * np.pi * (1 - nodes[j]))
                part = np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, y)
                out = 0.5 * weights[j] * np.real(radius * turn * part)
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])
    rows = spark.range(0, points, 1, points).mapInArrow(run, "part binary").collect()
    return sum(np.frombuffer(r["part"]).reshape(y.shape) for r in rows)


def leading(spark: SparkSession, v: np.ndarray, k: int, points: int = POINTS, spare: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns) of the k largest positive eigenvalues
    of a symmetric matrix, to double precision, by falling value; of fewer if
    fewer are positive."""
    low, high, m = interval(v, k)
    if m == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    width = min(len(v), m + max(spare, m // 2))
    while True:
        y, best, values, vectors = np.random.default_rng(11).normal(size=(len(v), width)), np.inf, None, None
        for _ in range(MAX_ROUNDS):
            q = np.linalg.qr(_projected(spark, v, y, low, high, points))[0]
            ritz, turn = np.linalg.eigh(q.T @ v @ q)
            y = q @ turn
            inside = np.flatnonzero((ritz > low) & (ritz < high))[::-1]
            if len(inside) != m:
                continue
            worst = np.linalg.norm(v @ y[:, inside] - y[:, inside] * ritz[inside], axis=0).max() / high
            if worst < best:
                values, vectors = ritz[inside], y[:, inside]
            if worst <= 1e-15 or worst > best / 4:  # rounding alone is left
                break
            best = min(best, worst)
        if values is not None and min(best, worst) <= 1e-12:
            break
        if width == len(v):
            raise RuntimeError(f"inertia counts {m} eigenvalues above {low}, the contour found {len(inside)}")
        width = min(len(v), 2 * width)
    values, vectors = values[:k], vectors[:, :k]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


# ------------------------------------------------------------------ the operator
def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """sum((n x - S)^2) of each row, exactly; None beyond 38 digits."""
    reach = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if x.shape[1] * reach ** 2 < 1 << 62 else object
    off = x.astype(kind) * n - np.array(sums, kind)
    return [Decimal(int(s)) if int(s) < 10 ** 38 else None for s in (off * off).sum(axis=1)]


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
           points: int = POINTS) -> DataFrame:
    """The rows of ``vectors`` with a usable vector, with RESULTS.

    A vector that is null or holds a null, NaN or infinite entry is dropped;
    a shorter one is filled with zeros to the longest. Entries c become
    x = floor(``scale`` c), at the ends of a long where they pass them. The
    fit list holds each distinct x once: n vectors with sums S.
    ``deviation`` is the exact sum of (n x - S)^2 (decimal; null beyond 38
    digits). ``whitened`` is x - S/n on the unit eigenvectors of the fit
    list's covariance (divisor n) with the largest values e, over sqrt(e),
    ``explained`` e / trace, both arrays by falling e, with fewer than
    ``components`` entries if fewer e are positive (none for a single
    vector or for empty ones). ``identity_error`` is
    the largest entry of |covariance of whitened - identity| on the fit list
    (null without components). Repeated rows give repeated results. A table
    without usable vectors gives an empty table. Results replace input
    columns of their names."""
    spark = vectors.sparkSession
    ready(spark)
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    usable = vectors.filter(quoted(vector).isNotNull()).filter(F.forall(quoted(vector), entry))
    dim = usable.agg(F.max(F.size(quoted(vector)))).first()[0] or 0
    x = F.transform(quoted(vector), lambda c: F.floor(c.cast("double") * scale))
    filled = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(x))).alias("x")
    fit = written(usable.select(filled).distinct(), "fit-list")
    n, sums = exact_sums(fit)
    mean = np.array([s / n for s in sums])

    def outer(x):
        centred = x - mean
        return (centred.T @ centred).ravel()
    covariance, values, axes = np.zeros((dim, dim)), np.zeros(0), np.zeros((dim, 0))
    if n and dim:
        covariance = _summed(fit, dim * dim, outer).reshape(dim, dim) / n
        covariance = (covariance + covariance.T) / 2
        values, axes = leading(spark, covariance, components, points)
    k, project = len(values), axes / np.sqrt(values)
    explained = (values / np.trace(covariance)).tolist() if k else []

    def again(x):
        w = (x - mean) @ project
        return np.append((w.T @ w).ravel(), w.sum(axis=0))
    error = None
    if k:
        moments = _summed(fit, k * k + k, again) / n
        error = float(np.abs(moments[:k * k].reshape(k, k) - np.outer(moments[k * k:], moments[k * k:]) - np.eye(k)).max())

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, rows = _matrix(b.column("x")), b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([n] * rows, pa.int64()), pa.array(_deviations(x, n, sums), pa.decimal128(38, 0)),
                 pa.array(((x - mean) @ project).tolist(), pa.list_(pa.float64())),
                 pa.array([explained] * rows, pa.list_(pa.float64())), pa.array([error] * rows, pa.float64())], ["row", *RESULTS])
    work = packed(usable, x=filled)
    row = row_ddl(work)
    out = work.mapInArrow(run, f"row {row}, n long, deviation decimal(38,0), whitened array<double>, "
                               "explained array<double>, identity_error double")
    return unpacked(out, vectors.columns, RESULTS)
