"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries are put on a grid of whole numbers, so sums are exact in any order. A first pass counts vectors and adds
up dimensions; a second one centres by the rounded mean and adds up products of small whole numbers. What the
rounding left is taken off exactly, in rational arithmetic. The dimensions' square is all that the driver holds.

The scatter is factored with pivots down to its rank. Rotating the factor's columns until they are orthogonal
gives the components: their norms squared are the eigenvalues, the columns over their norms the eigenvectors.

Defined results: a null vector, one with null or non-finite entries, and an empty one is dropped; so is one with an
entry of 2^30 or more, and one whose length is not the commonest (the longest of those equally common). Where the scatter's rank is
lower than the components asked for (repeated rows, one row), there are as many components as the rank. Repeated rows
count each and get equal rows; a null id stays null. An empty table gives no rows. A deviation beyond 38 digits is
null. The id and the vector alone are read, so no column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The grid: floor(GRID * entry) + OFFSET.
GRID, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries must be smaller, so that products of 2^40 rows have at most 38 digits.
LARGEST = 1 << 30
#: Doubles hold whole numbers below _EXACT, longs those below _LONG.
_EXACT, _LONG = 1 << 53, 1 << 62


def usable(vector: Column) -> Column:
    """Not null or empty, and no entry null, non-finite or too large for the grid."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))), F.lit(False))


def on_grid(vectors) -> np.ndarray:
    """An Arrow array of lists of one length as a matrix of whole numbers."""
    import pyarrow as pa

    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * GRID).astype(np.int64).reshape(len(vectors), -1) + OFFSET


def products(y: np.ndarray) -> np.ndarray:
    """Exact y' y, as Python numbers: by doubles as long as they hold every partial sum, by halves beyond, one by one at last."""
    most = int(np.abs(y).max()) ** 2 * len(y)
    if most < _EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(y) > 1:
        return products(y[: len(y) // 2]) + products(y[len(y) // 2 :])
    return np.outer(y[0].astype(object), y[0].astype(object))


def _added(table: DataFrame, of_matrix) -> dict[int, int]:
    """Sums of whole numbers over the matrices of all batches, by place: a task adds up its own, Spark adds those."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                found = of_matrix(on_grid(batch.column(0)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array([str(v) for v in total])], names=["at", "v"])

    rows = table.mapInArrow(run, "at long, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return {r["at"]: int(r.v) for r in rows}


def _column_sums(x: np.ndarray) -> np.ndarray:
    return np.append(x.sum(axis=0), len(x)).astype(object)


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower triangular L (rank columns) and the order p of dimensions with v[p][:, p] = L L', largest pivot first."""
    a, d = v.copy(), len(v)
    p, rank = np.arange(d), d
    low = np.zeros((d, d))
    limit = d * np.finfo(float).eps * max(0.0, float(np.diag(v).max()))
    for k in range(d):
        at = k + int(np.argmax(np.diag(a)[k:]))
        if a[at, at] <= limit:
            rank = k
            break
        for m in (a, low):
            m[[k, at]] = m[[at, k]]
        a[:, [k, at]] = a[:, [at, k]]
        p[[k, at]] = p[[at, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low[:, :rank], p


def one_sided_jacobi(low: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Rotates pairs of columns until all are orthogonal to double precision."""
    w = low.copy()
    for _ in range(rounds):
        turned = False
        for i in range(w.shape[1] - 1):
            for j in range(i + 1, w.shape[1]):
                a, b = w[:, i], w[:, j]
                aa, bb, ab = float(a @ a), float(b @ b), float(a @ b)
                if abs(ab) <= 4 * np.finfo(float).eps * np.sqrt(aa * bb):
                    continue
                turned = True
                z = (bb - aa) / (2 * ab)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                w[:, i], w[:, j] = c * a - c * t * b, c * t * a + c * b
        if not turned:
            break
    return w


@dataclass
class Fit:
    """Number of vectors, sums of dimensions, trace of the covariance, and the components (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.n * int(np.abs(x).max()) + max(map(abs, self.sums)) >= _LONG:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def whitened(self, z: np.ndarray, k: int) -> np.ndarray:
        return (z / self.n).astype(np.float64) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def decompose(n: int, sums: list[int], scatter: list[list[Fraction]]) -> Fit:
    """scatter: n times the covariance, exact."""
    v = np.array([[float(x / n) for x in row] for row in scatter])
    low, p = pivoted_cholesky(v)
    w = one_sided_jacobi(low)
    norms = np.sqrt((w * w).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    vectors = np.zeros((len(v), len(order)))
    vectors[p] = w[:, order] / norms[order]
    return Fit(n, sums, float(sum(scatter[i][i] for i in range(len(v))) / n), norms[order] ** 2, vectors)


def _squares(z: np.ndarray) -> list[str]:
    """Exact sums of squares of rows, as texts."""
    if z.dtype == object or int(np.abs(z).max()) ** 2 * z.shape[1] >= _LONG:
        z = z.astype(object)
    return [str(v) for v in (z * z).sum(axis=1)]


class Whitening:
    """``fit``: the components (None without vectors); ``rows``: vec_id, component, n, deviation, whitened, explained, identity_error."""

    def __init__(self, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS):
        vector = F.col(vector_col)
        clean = table.select(F.col(id_col).alias("vec_id"), vector.alias("vector")).where(usable(F.col("vector")))
        lengths = clean.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("length")).limit(1).collect()
        self._clean = clean.where(F.size("vector") == (lengths[0].length if lengths else 0))
        self._id = table.schema[id_col].dataType
        self.fit = self._fitted() if lengths else None
        self.components = min(components, len(self.fit.values)) if self.fit else 0
        self.identity_error = self._measured() if self.components else 0.0

    def _fitted(self) -> Fit:
        vectors = self._clean.select("vector")
        found = _added(vectors, _column_sums)
        d = len(found) - 1
        n, sums = found[d], [found[i] for i in range(d)]
        centre = [(2 * s + n) // (2 * n) for s in sums]
        found = _added(vectors, lambda x: products(x - np.array(centre)).ravel())
        rest = [s - n * m for s, m in zip(sums, centre, strict=True)]
        return decompose(n, sums, [[found[i * d + j] - Fraction(rest[i] * rest[j], n) for j in range(d)] for i in range(d)])

    def _measured(self) -> float:
        """The largest entry of the whitened vectors' covariance less the identity; n x - S adds up to nothing, so they are centred."""
        fit, k = self.fit, self.components

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    w = fit.whitened(fit.centred(on_grid(batch.column(0))), k)
                    total += w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k)), pa.array(total.ravel())], names=["at", "v"])

        added = self._clean.select("vector").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        return max(abs(r.v / fit.n - (r["at"] // k == r["at"] % k)) for r in added)

    @property
    def rows(self) -> DataFrame:
        fit, k = self.fit, self.components

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows and k:
                    z = fit.centred(on_grid(batch.column(1)))
                    w = fit.whitened(z, k)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_squares(z)), lists], names=["vec_id", "deviation", "w"])

        schema = T.StructType([T.StructField("vec_id", self._id), T.StructField("deviation", T.StringType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
        found = self._clean.mapInArrow(run, schema)
        explained = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values[:k]]) if k else F.array().cast("array<double>")
        deviation = F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation")
        each = found.select("vec_id", deviation, F.posexplode("w").alias("at", "whitened"))
        return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n if fit else 0).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(self.identity_error).alias("identity_error"))
