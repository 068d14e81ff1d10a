"""Embedding whitening by a pivoted Cholesky factor and one-sided Jacobi rotations.

The rows are read in parallel and no vector is moved: for the sums of each dimension (integers, exact), for the centred
scatter, for the results, and once more to measure how white they are. What a task sends is one d x d matrix, added up by
entry, so the driver gets d * (d + 1) / 2 numbers however many rows there are.

Entries are integers, so the mean is split into its whole part, taken off exactly, and a fraction of less than one;
products are made after that. The scatter A of the centred rows is factored with diagonal pivoting, A = L L' up to its
rank. Jacobi rotations then make the columns of L orthogonal to each other, working on L itself and never on L' L. The
columns' norms squared are the eigenvalues of A and the columns at length one its eigenvectors, to high relative
accuracy also for small ones.

Rows whose vector is null, empty, or has a null or non-finite entry are left out. Vectors of several lengths are an error.
Null or repeated ids and repeated rows are rows like any other. Directions in which the rows do not vary (beyond rounding) have no whitened value,
so there are as many components as the rank, at most ``components``; with no rows, or all rows equal, the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcomp.llm import common as C
from haulcomp.llm import vectors as V

#: How an entry becomes an integer.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rounds of rotations at most; a few are enough.
SWEEPS = 60
EPS = np.finfo(float).eps


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order p and lower trapezoid L with a[p][:, p] = L L', as many columns as the rank."""
    a = np.array(a, float)
    d = len(a)
    order, low = np.arange(d), np.zeros((d, d))
    left = a.diagonal().copy()
    # What is left of a diagonal entry is rounding below this; measured by the entry itself, so scales may differ.
    least = d * EPS * left
    for k in range(d):
        open_ = np.where(left[k:] > least[k:], left[k:], -1.0)
        j = k + int(np.argmax(open_))
        if open_[j - k] < 0:
            return order, low[:, :k]
        for x in (order, left, least, low):
            x[[k, j]] = x[[j, k]]
        low[k, k] = np.sqrt(left[k])
        rest = a[order[k + 1 :], order[k]] - low[k + 1 :, :k] @ low[k, :k]
        low[k + 1 :, k] = rest / low[k, k]
        left[k + 1 :] -= low[k + 1 :, k] ** 2
    return order, low


def jacobi(low: np.ndarray) -> np.ndarray:
    """Columns spanning the same matrix L L', rotated in pairs until all are orthogonal."""
    g = low.copy()
    d, k = g.shape
    for _ in range(SWEEPS):
        turned = False
        for i in range(k - 1):
            for j in range(i + 1, k):
                x, y = g[:, i], g[:, j]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= np.sqrt(d) * EPS * np.sqrt(xx * yy):
                    continue
                turned = True
                z = (yy - xx) / (2 * xy)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                g[:, i], g[:, j] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return g


@dataclass(frozen=True)
class Whitening:
    """Fitted on n vectors: integer sums, eigenvalues by falling size, unit eigenvectors as columns, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and fraction."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, part = self.mean
        return (x - whole).astype(float) - part

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        k = min(components, len(self.values))
        return self.centred(x) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S) ** 2, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        near = x - whole
        # |n near - rest| < n * (largest + 1), so this tells whether 64 bits hold the sum.
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            off = near * np.int64(self.n) - rest.astype(np.int64)
            return (off * off).sum(axis=1)
        off = near.astype(object) * self.n - rest
        total = (off * off).sum(axis=1)
        if len(total) and max(total) >= 1 << 63:
            raise OverflowError("a deviation is beyond 64 bits; fit on fewer rows")
        return total.astype(np.int64)


def integers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and ``x``, the vector's integers, of the rows that take part."""
    kept = rows.filter(V.usable(rows[vector]))
    # A sum beyond 64 bits becomes the largest number, which ``dimension`` refuses.
    moved = F.transform(V.scaled(kept[vector], SCALE), lambda x: F.coalesce(F.try_add(x, F.lit(OFFSET)), F.lit((1 << 63) - 1)))
    return kept.select(kept["vec_id"], moved.alias("x"))


def _products(rows: DataFrame, of, width: int, d: int) -> np.ndarray:
    """Sum of y' y over all rows, y = of(vectors of ``width`` integers) of d entries; a task sends one matrix."""
    schema = C.fields("entry int, v double")
    upper = np.triu_indices(d)

    def run(it):
        total = np.zeros((d, d))
        for batch in it:
            if batch.num_rows:
                y = of(V.matrix(batch.column(0), width))
                total += y.T @ y
        yield C.batches(schema, pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper]))

    sums = C.map_arrow(rows.select("x"), run, schema).groupBy("entry").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for entry, v in sums.collect():
        out[upper[0][entry], upper[1][entry]] = out[upper[1][entry], upper[0][entry]] = v
    return out


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of an ``integers`` table; None if it has no rows."""
    d = V.dimension(rows, "x")
    if d is None:
        return None
    n = rows.count()
    # Decimal sums do not overflow.
    by_entry = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    found = {r.at: int(r.s) for r in by_entry.collect()}
    sums = [found[i] for i in range(d)]
    raw = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    scatter = _products(rows, raw.centred, d, d)
    order, low = pivoted_cholesky(scatter / n)
    g = jacobi(low)
    norms = np.linalg.norm(g, axis=0)
    falling = np.argsort(-norms, kind="stable")
    components = np.zeros_like(g)
    components[order] = g[:, falling] / norms[falling]
    return Whitening(n, sums, norms[falling] ** 2, components, float(np.trace(scatter)) / n)


def identity_error(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """Largest entry of the measured covariance of the whitened rows minus the identity."""
    k = min(components, len(model.values))
    cov = _products(rows, lambda x: model.whitened(x, components), len(model.sums), k) / model.n
    return float(np.abs(cov - np.eye(k)).max()) if k else 0.0


def _result(rows: DataFrame) -> str:
    key = rows.schema["vec_id"].dataType.simpleString()
    return f"vec_id {key}, component int, n bigint, deviation bigint, whitened double, explained double"


def whiten(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """Each row of an ``integers`` table once per component, with ``deviation``, ``whitened`` and ``explained``."""
    schema = C.fields(_result(rows))
    k = min(components, len(model.values))
    explained = model.values[:k] / model.trace if k else model.values[:k]

    def run(it):
        for whole in it:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                x = V.matrix(batch.column(1), len(model.sums))
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield C.batches(
                    schema,
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(np.repeat(model.deviation(x), k)),
                    pa.array(model.whitened(x, components).ravel()),
                    pa.array(np.tile(explained, m)),
                )

    return C.map_arrow(rows.select("vec_id", "x"), run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(C.table(spark, sf_dir, "embeddings"))
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], _result(rows) + ", identity_error double")
    return whiten(rows, model).withColumn("identity_error", F.lit(identity_error(rows, model)))
