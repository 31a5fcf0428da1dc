"""Whitening of embeddings by eigenvectors in more than double precision.

Entries become whole numbers, so everything up to the eigenvectors is exact: the sums of the distinct
vectors, and the sums of products of what is left of each vector after the whole-number mean is taken
off. Each partition multiplies blocks of rows as floating-point matrices whose entries are kept so
small that no product or sum is rounded, and the partitions' sums are added up by Spark, cell by cell.
The covariance follows from whole numbers by one division.

Its eigenvectors come from a float32 solver, several digits of which are right, and are corrected by
Ogita and Aishima's iteration: with R = I - X'X and S = X'AX, each column is corrected by the others,
``E[i, j] = (S[i, j] + l[j] R[i, j]) / (l[j] - l[i])``, which doubles the number of right digits a step
by four matrix products in extended precision. Eigenvalues nearer to one another than the step's error
bound can't be told apart by it; their vectors are only made orthogonal, and then a sub-solve of the
covariance restricted to their space, with their mean taken off, separates them on a scale of its own.

Defined results: a vector that is null or empty, or holds a null, a NaN, an infinity or an entry of
2**55 or more (whose whole number is no long) is left out, as are vectors of another length than the
most frequent one (the longest of several). Repeated rows and rows without an id each get their rows of
the result, and count once in the fit. Components whose eigenvalue can't be told from zero (below d *
2**-60 of the largest; all, if there is one distinct vector) don't exist, so there may be fewer than
asked for. Of a component's two signs that is taken by which its largest entry is positive. A deviation
beyond a long is null. Extra columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, staged

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
HIGH = np.longdouble
#: Rows and bits of the matrix blocks whose products double precision holds exactly: 2 * 20 + 12 bits.
BLOCK, LIMB = 1 << 12, 20
#: Bits of the parts in which whole sums go through Spark.
PART = 48


def whole(vector: Column) -> Column:
    """The vector as longs, or null where it has none."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) >= float(1 << 55))
    longs = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    return F.when((F.size(vector) > 0) & ~F.exists(vector, bad), longs)


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """``y`` as float64 matrices of LIMB bits each, the last of which has the sign."""
    out = []
    while np.abs(y).max(initial=0) > 1 << LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(float))
        y = y >> LIMB
    return [*out, y.astype(float)]


def products(y: np.ndarray) -> np.ndarray:
    """The exact ``y.T @ y``, as Python numbers."""
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), BLOCK):
        parts = limbs(y[at : at + BLOCK])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def summed(fit: DataFrame, size: int, of) -> list[int]:
    """The exact sums over all rows of the ``size`` whole numbers that ``of`` gives for a batch."""

    def partial(batches):
        total, rows = np.zeros(size, object), 0
        for b in batches:
            if b.num_rows:
                total, rows = total + of(b), rows + b.num_rows
        if rows:
            cells = [np.arange(size), *((total >> PART * k) & ((1 << PART) - 1) for k in (0, 1)), total >> 2 * PART]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cells], ["cell", "low", "mid", "high"])

    parts = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("low", "mid", "high")]
    out = [0] * size
    for r in arrow_map(fit, partial, "cell long, low long, mid long, high long").groupBy("cell").agg(*parts).collect():
        out[r["cell"]] = int(r["low"]) + (int(r["mid"]) << PART) + (int(r["high"]) << 2 * PART)
    return out


def high(values) -> np.ndarray:
    return np.array([HIGH(v) for v in np.ravel(np.asarray(values, object))], HIGH)


def orthonormal(x: np.ndarray) -> np.ndarray:
    """``x``, nearly orthonormal, with twice as many right digits (a Newton-Schulz step)."""
    return x @ (1.5 * np.eye(x.shape[1], dtype=HIGH) - x.T @ x / 2)


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors, bound): ``x`` after Ogita-Aishima steps, and what lies nearer than the
    bound is not separated yet."""
    unit, norm = np.eye(len(a), dtype=HIGH), np.sqrt((a * a).sum())
    last, best = np.inf, (None, x, np.inf)
    for _ in range(60):  # a few, but for what lies little beyond the bound
        r = unit - x.T @ x
        s = x.T @ a @ x
        value = np.diag(s) / (1 - np.diag(r))
        bound = 8 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + norm * np.sqrt((r * r).sum()))
        gap = value[None, :] - value[:, None]
        near = np.abs(gap) <= bound
        e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, gap))
        step = np.abs(e).max()
        going = step < last / 2 or bound < best[2] / 2
        if bound < best[2]:
            best = value, x, bound
        if not going:  # what is left is rounding, or for a sub-solve
            break
        x, last = orthonormal(x + x @ e), step
    value, x, bound = best
    return value, orthonormal(x), bound


def clusters(value: np.ndarray, bound: float) -> list[np.ndarray]:
    """Runs of eigenvalues each nearer to the next than the bound."""
    order = np.argsort(value)
    return [c for c in np.split(order, np.flatnonzero(np.diff(value[order]) > bound) + 1) if len(c) > 1]


def eigen(a: np.ndarray, seed=np.float32) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors in columns) of a symmetric matrix, the largest first."""
    d, size = len(a), np.abs(a).max(initial=0)
    if d < 2 or size == 0:
        return np.diag(a).astype(HIGH), np.eye(d, dtype=HIGH)
    a = a / size
    x, least = np.linalg.eigh(a.astype(seed))[1].astype(HIGH), 4 * d * np.finfo(HIGH).eps
    for _ in range(8):
        value, x, bound = corrected(a, x)
        solved = False
        for near in clusters(value, bound):
            q = x[:, near]
            t = q.T @ (a @ q)
            t = (t + t.T) / 2 - value[near].mean() * np.eye(len(near), dtype=HIGH)
            if np.abs(t).max() <= least:
                continue  # one eigenvalue, as far as can be told: any basis of its space will do
            if len(near) == d and np.abs(t).max() > 0.5:  # the seed tells none apart
                if seed is np.float32:
                    return eigen(a * size, np.float64)
                continue
            x[:, near], solved = q @ eigen(t)[1], True
        if not solved:
            break
    order = np.argsort(-value, kind="stable")
    return value[order] * size, x[:, order]


class Fit:
    """What whitening needs to know: sizes, the mean as a whole number and a rest, and components."""

    def __init__(self, n: int, sums: list[int], gram: list[int] | None = None, mean: list[int] | None = None, components: int = COMPONENTS):
        self.n, self.d = n, len(sums)
        self.mean = mean if mean is not None else nearest(n, sums)
        self.rest = [s - n * m for s, m in zip(sums, self.mean, strict=True)]
        if gram is None:
            return
        g, t = np.array(gram, object).reshape(self.d, self.d), np.array(self.rest, object)
        cov = (high(n * g - np.outer(t, t)) / HIGH(n) / HIGH(n)).reshape(self.d, self.d)
        self.trace = np.trace(cov)
        value, x = eigen(cov)
        some = max(0, int((value > self.d * HIGH(2) ** -60 * max(value.max(initial=0), HIGH(0))).sum()))
        k = min(components, some)
        x = x[:, :k] * np.sign(x[np.abs(x[:, :k]).argmax(0), np.arange(k)])
        self.values = value[:k].astype(float)
        self.explained = (value[:k] / self.trace).astype(float) if k else np.zeros(0)
        self.axes = x.astype(float)
        self.roots = np.sqrt(value[:k]).astype(float)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """The vectors less the whole-number mean."""
        return x - np.array(self.mean, np.int64)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        rest = (high(self.rest) / HIGH(self.n)).astype(float)
        return (y - rest) @ self.axes / self.roots

    def deviations(self, y: np.ndarray) -> list[int | None]:
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest))
        if self.d * most * most < 1 << 63:
            z = self.n * y - np.array(self.rest, np.int64)
            return (z * z).sum(1).tolist()
        z = self.n * y.astype(object) - np.array(self.rest, object)
        return [v if v < 1 << 63 else None for v in (z * z).sum(1)]


def nearest(n: int, sums: list[int]) -> list[int]:
    return [(2 * s + n) // (2 * n) for s in sums]


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Fit | None:
    """The fit to ``vectors`` (distinct, in ``x``, staged), or None if there are none."""
    n, *sums = summed(vectors, d + 1, lambda b: np.array([b.num_rows, *column_sums(matrix(b, d))], object))
    if not n:
        return None
    mean = nearest(n, sums)
    gram = summed(vectors, d * d, lambda b: products(matrix(b, d) - np.array(mean, np.int64)).ravel())
    return Fit(n, sums, gram, mean, components)


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of longs: the upper and the lower bits apart."""
    up, low = (x >> 31).sum(0).tolist(), (x & ((1 << 31) - 1)).sum(0).tolist()
    return [(a << 31) + b for a, b in zip(up, low, strict=True)]


def identity_error(vectors: DataFrame, found: Fit) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    k = len(found.values)
    if not k:
        return 0.0

    def partial(batches):
        total, rows = np.zeros(k * k + k), 0
        for b in batches:
            if b.num_rows:
                w = found.whitened(found.centred(matrix(b, found.d)))
                total, rows = total + np.concatenate([(w.T @ w).ravel(), w.sum(0)]), rows + b.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(total)], ["cell", "value"])

    total = np.zeros(k * k + k)
    for r in arrow_map(vectors, partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r["cell"]] = r["value"]
    mean = total[k * k :] / found.n
    cov = total[: k * k].reshape(k, k) / found.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component."""
    longs = rows.select(F.col(key).cast("long").alias("vec_id"), whole(F.col(vector)).alias("x")).filter("x is not null")
    usual = longs.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not usual:
        return rows.sparkSession.createDataFrame([], RESULT)
    d = usual[0]["d"]
    longs = longs.filter(F.size("x") == d)
    distinct = staged(longs.select("x").distinct(), "vectors")
    found = fit(distinct, d, components)
    error, k = identity_error(distinct, found), len(found.values)

    def projected(batches):
        for b in batches:
            y = found.centred(matrix(b, d))
            m = len(y)
            w = found.whitened(y).ravel() if k else np.zeros(0)
            ids, deviation = (pa.array(c, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))) for c in (b.column("vec_id").to_pylist(), found.deviations(y)))
            same = [np.tile(c, m) for c in (np.arange(1, k + 1, dtype=np.int32), found.explained, found.values)]
            columns = [ids, pa.array(same[0]), pa.array(np.full(m * k, found.n)), deviation, pa.array(w), pa.array(same[1]), pa.array(np.full(m * k, error)), pa.array(same[2])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    return arrow_map(longs, projected, RESULT)
