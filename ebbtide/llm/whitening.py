"""Embedding whitening by shifted CholeskyQR.

The entries c of a vector become whole numbers x = floor(scale * c) + offset.  With C the centred
rows, the first pass over all rows sums the Gram matrix C'C, adds a small shift to its diagonal, so
that its Cholesky factor exists however ill-conditioned C is, and takes R from it.  Each further pass
brings the rows to C R^-1 by triangular solves in the tasks, sums their Gram matrix, and composes its
factor with R, until the rows are orthonormal.  The singular values and right singular vectors of R
(times the root of the last Gram matrix, which is the identity unless the rank is short) are those
of C: condition numbers are never squared in the result.

Tasks hand on one d x d matrix each, element by element, and Spark adds these up; the driver holds
d x d matrices only.  Means and deviations come from whole numbers and are exact.

Defined cases: vectors that are null, empty, of another length than most (ties: the longer), or hold
null or non-finite entries, or entries over ``LARGEST`` in magnitude once scaled, take no part;
repeated rows count each and come out each; a null vec_id takes part like any other; directions
without variance (constant entries, fewer rows than entries) have no component; no usable rows give
no rows; a deviation that no long can hold is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.lineage import stored

LARGEST = 2.0 ** 50
#: Passes over the rows at most; three do unless the rank is short.
PASSES = 6
#: Singular values under this share of the largest are rounding.
RANK_SHARE = 1e-11
_LOW_BITS = 26


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def whole_vectors(vectors: DataFrame, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c))
    usable = F.forall("embedding", lambda c: F.coalesce(
        ~F.isnan(c.cast("double")) & (F.abs(F.lit(float(scale)) * c.cast("double")) < F.lit(LARGEST)), F.lit(False)))
    rows = (vectors.filter(F.coalesce(usable, F.lit(False)) & (F.size("embedding") > 0))
            .select("vec_id", F.transform(scaled, lambda x: x + F.lit(offset).cast("long")).alias("x")))
    rows = stored(rows)
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (common["d"] if common else 0))


@dataclass
class Centre:
    """Exact means of n rows: ``floors`` + ``rests`` / n, with 0 <= rests < n."""
    n: int
    floors: np.ndarray
    rests: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floors).astype(np.float64) - self.rests / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum over dimensions of (n x - S)^2, exact; null beyond a long."""
        near = x - self.floors
        most = int(np.abs(near).max(initial=0)) * self.n + self.n
        if most * most * x.shape[1] < 2 ** 62:
            return ((near * self.n - self.rests) ** 2).sum(axis=1).tolist()
        own = ((near.astype(object) * self.n - self.rests.astype(object)) ** 2).sum(axis=1)
        return [v if v < 2 ** 63 else None for v in own]


def _added(rows: DataFrame, part, kind: str) -> np.ndarray:
    """Sum over all rows of the vector that ``part(x)`` gives for a batch."""
    arrow = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(matrix(batch.column("x")))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int64()), pa.array(total, arrow)], names=["k", "v"])
    value = F.col("v").cast("decimal(19,0)") if kind == "long" else F.col("v")
    found = rows.select("x").mapInArrow(run, f"k long, v {kind}").groupBy("k").agg(F.sum(value).alias("v")).toPandas()
    return found.sort_values("k")["v"].to_numpy()


def centre_of(rows: DataFrame) -> Centre | None:
    """Exact mean of each entry; None without rows."""
    def part(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> _LOW_BITS).sum(0), (x & ((1 << _LOW_BITS) - 1)).sum(0)])
    found = [int(v) for v in _added(rows, part, "long")]
    if not found:
        return None
    n, d = found[0], (len(found) - 1) // 2
    sums = [(high << _LOW_BITS) + low for high, low in zip(found[1:1 + d], found[1 + d:])]
    return Centre(n, np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64))


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangular R, by forward substitution."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _gram(rows: DataFrame, centre: Centre, factors: list[np.ndarray]) -> np.ndarray:
    d = len(centre.floors)

    def part(x: np.ndarray) -> np.ndarray:
        q = centre.centred(x)
        for r in factors:
            q = solved(q, r)
        return (q.T @ q).ravel()
    return _added(rows, part, "double").astype(float).reshape(d, d)


def _upper(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; with a shift where asked or needed."""
    d = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = max(11 * (n * d + d * (d + 1)) * 2.0 ** -53 * np.trace(gram), 1e-300)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


@dataclass
class Whitening:
    """Means, unit components (columns, by falling eigenvalue) and all eigenvalues of the covariance."""
    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int

    def apply(self, x: np.ndarray, k: int) -> np.ndarray:
        k = min(k, self.components.shape[1])
        return self.centre.centred(x) @ (self.components[:, :k] / np.sqrt(self.eigenvalues[:k]))


def fit(rows: DataFrame) -> Whitening | None:
    """Fit on rows with ``x`` of one length; None without rows."""
    centre = centre_of(rows)
    if centre is None:
        return None
    d, factors = len(centre.floors), []
    gram = _gram(rows, centre, factors)
    total = float(np.trace(gram))
    if total > 0:
        while len(factors) < PASSES and np.abs(gram - np.eye(d)).max() > 1e-13 * d:
            factors.append(_upper(gram, centre.n, not factors))
            gram = _gram(rows, centre, factors)
    r = np.eye(d)
    for factor in factors:
        r = factor @ r
    weight, basis = np.linalg.eigh(gram)
    _, single, right = np.linalg.svd(np.sqrt(np.maximum(weight, 0))[:, None] * (basis.T @ r))
    kept = single > max(RANK_SHARE * single[0], 1e-150)
    components = right[kept].T
    heaviest = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])] if kept.any() else np.ones(0)
    return Whitening(centre, components * np.sign(heaviest), single[kept] ** 2 / centre.n, total / centre.n, len(factors) + 1)


def identity_error(rows: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows, less the identity."""
    k = min(k, model.components.shape[1])

    def part(x: np.ndarray) -> np.ndarray:
        w = model.apply(x, k)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])
    v = _added(rows, part, "double").astype(float) / model.centre.n
    return float(np.abs(v[k:].reshape(k, k) - np.outer(v[:k], v[:k]) - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, k: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, n, deviation, whitened array, explained array, identity_error): a row for each usable row
    of ``vectors`` (vec_id, embedding), with its first ``k`` whitened entries."""
    rows = whole_vectors(vectors, scale, offset)
    model = fit(rows)
    key = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {key}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model, k)
    shares = (model.eigenvalues[:k] / model.trace if model.trace else model.eigenvalues[:k]).tolist()
    lists = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            many = len(x)
            yield pa.record_batch(
                [batch.column("vec_id"), pa.array([model.centre.n] * many, pa.int64()),
                 pa.array(model.centre.deviations(x), pa.int64()), pa.array(list(model.apply(x, k)), lists),
                 pa.array([shares] * many, lists), pa.array([error] * many, pa.float64())],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, schema)
