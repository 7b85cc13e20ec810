"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gets its exact neighbour graph; the graph is cut into balanced parts by
recursive bisection (second eigenvector of the graph, split at the median, then swaps that lower the
cut).  A small softmax classifier learns the parts and then places every row of the table and routes
every query to its most probable parts, where exact distances decide.  How many parts that takes is measured
on sample vectors that the fit has not seen.

Parts are dealt out in blocks of about ``BLOCK_ROWS`` candidates and ``BLOCK_QUERIES`` queries, so
neither a common vector nor a popular part meets in one task, and only the best ``k`` of each block
go on.  The sample, graph and classifier are bounded by ``SAMPLE_ROWS``; they are fitted once on the
driver, and every row of the table is indexed.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as queries or candidates; a null vec_id takes no part; rows with the
query's vec_id are its own; repeated rows are candidates each, and one query; of equal distances the
smaller vec_id is nearer; with fewer candidates than ``k`` all found are returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.operators.lineage import stored

#: Vectors that the graph and the classifier are fitted on, at most.
SAMPLE_ROWS = 8_192
#: Rows that a part should hold, and parts at most.
PART_ROWS, MAX_PARTS = 2_000, 256
#: Queries visit as many parts as unseen vectors of the sample need for this recall.
TARGET_RECALL = 0.96
GRAPH_NEIGHBOURS = 12
BLOCK_ROWS, BLOCK_QUERIES = 4_000, 2_000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of each row."""
    n, norms = len(x), (x * x).sum(1)
    k = min(k, n - 1)
    out = np.zeros((n, k), dtype=np.int64)
    for at in range(0, n, 512):
        d = norms[at:at + 512, None] + norms[None] - 2 * x[at:at + 512] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at:at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _bisect(edges: tuple[np.ndarray, np.ndarray], n: int, rng: np.random.Generator) -> np.ndarray:
    """Sides (False, True) of a balanced cut of the graph with these (undirected) edges."""
    a, b = edges
    degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1).astype(float)
    root = np.sqrt(degree)
    v = rng.normal(size=n)
    for _ in range(60):
        v -= root * (v @ root) / (root @ root)
        u = v / root
        w = (np.bincount(a, u[b], n) + np.bincount(b, u[a], n)) / root
        v = w + v  # shifted, so the largest eigenvalue is the wanted one
        v /= max(np.linalg.norm(v), 1e-300)
    order = np.argsort(v / root, kind="stable")
    side = np.zeros(n, dtype=bool)
    side[order[n // 2:]] = True
    for _ in range(8):
        # Gain of moving a vertex: its edges across less its edges inside; swap the best pairs.
        across = side[a] != side[b]
        gain = (np.bincount(a, np.where(across, 1, -1), n) + np.bincount(b, np.where(across, 1, -1), n))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 50))
        better = gain[left[:m]] + gain[right[:m]] > 2
        if not better.any():
            break
        side[left[:m][better]], side[right[:m][better]] = True, False
    return side


def balanced_parts(x: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Part number of each row: recursive balanced cuts of the neighbour graph; ``parts`` a power of two."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(x), dtype=np.int64)
    if len(x) < 2:
        return label
    graph = neighbour_graph(x, GRAPH_NEIGHBOURS)
    a, b = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    size = 1
    while size < parts:
        new = label * 2
        for part in range(size):
            inside = np.flatnonzero(label == part)
            if len(inside) < 2:
                continue
            place = np.full(len(x), -1)
            place[inside] = np.arange(len(inside))
            keep = (place[a] >= 0) & (place[b] >= 0)
            new[inside] += _bisect((place[a[keep]], place[b[keep]]), len(inside), rng)
        label, size = new, size * 2
    return label


class Router:
    """Softmax classifier of vectors into parts."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int, steps: int = 300):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        z, y = self._inputs(x), np.eye(parts)[label]
        self.weights = np.zeros((z.shape[1], parts))
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for t in range(1, steps + 1):
            gradient = z.T @ (self.probabilities(x, z) - y) / len(z) + 1e-4 * self.weights
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient ** 2
            self.weights -= 0.1 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)

    def probabilities(self, x: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
        g = (self._inputs(x) if z is None else z) @ self.weights
        e = np.exp(g - g.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(good, F.lit(False)))
            .filter(F.exists("v", lambda x: x != 0)))
    common = (rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first())
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def probes_for(router: Router, known: np.ndarray, unseen: np.ndarray, k: int, target: float) -> int:
    """Parts to visit so that ``unseen`` vectors find this share of their k nearest in ``known``."""
    parts = router.probabilities(known).argmax(1)
    order = np.argsort(-router.probabilities(unseen), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    d = (known * known).sum(1)[None] - 2 * unseen @ known.T
    near = np.argpartition(d, min(k, len(known)) - 1, axis=1)[:, :k]
    visits = np.take_along_axis(place, parts[near], axis=1).ravel()
    share = np.cumsum(np.bincount(visits, minlength=order.shape[1])) / len(visits)
    return int(np.argmax(share >= target)) + 1


def fit(rows: DataFrame, n: int, k: int) -> tuple[Router | None, int]:
    """The router, and how many parts a query visits."""
    parts = 1
    while parts < MAX_PARTS and parts * PART_ROWS < n:
        parts *= 2
    sample = (rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)).toArrow()
    if parts == 1 or sample.num_rows < 2 * parts:
        return None, 1
    x = np.unique(_matrix(sample.column("v")), axis=0)
    if len(x) < 2 * parts:
        return None, 1
    x = np.random.default_rng(7).permutation(x)
    unseen, x = x[:len(x) // 8], x[len(x) // 8:]
    router = Router(x, balanced_parts(x, parts), parts)
    return router, probes_for(router, x, unseen, k, TARGET_RECALL)


def _placed(rows: DataFrame, router, probes: int) -> DataFrame:
    """(vec_id, v, part): rows with their ``probes`` most probable parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if router.value is None:
                part = np.zeros(batch.num_rows, dtype=np.int32)
                take = np.arange(batch.num_rows)
            else:
                p = router.value.probabilities(_matrix(batch.column("v")))
                part = np.argsort(-p, axis=1, kind="stable")[:, :probes].astype(np.int32).ravel()
                take = np.repeat(np.arange(batch.num_rows), probes)
            yield pa.record_batch([batch.column("vec_id").take(pa.array(take)), batch.column("v").take(pa.array(take)),
                                   pa.array(part)], names=["vec_id", "v", "part"])
    return rows.mapInArrow(run, "vec_id long, v array<double>, part int")


def nearest_in(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, distance) of the k nearest candidates of each query, by exact distances.

    A matrix product, with a bound of its rounding, picks those worth the exact sum.
    """
    out = []
    c_norm = (c * c).sum(1)
    for at in range(0, len(q), 64):
        block = q[at:at + 64]
        norm = (block * block).sum(1)
        rough = norm[:, None] + c_norm[None] - 2 * block @ c.T
        slack = 1e-12 * (norm + c_norm.max()) * c.shape[1]
        for i in range(len(block)):
            near = np.where(c_ids == q_ids[at + i], np.inf, rough[i])
            bar = np.partition(near, k - 1)[k - 1] if len(near) > k else np.inf
            some = np.flatnonzero((near <= bar + 2 * slack[i]) & (near < np.inf))
            d = np.sqrt(((c[some] - block[i]) ** 2).sum(1))
            first = np.lexsort((c_ids[some], d))[:k]
            out += [(int(q_ids[at + i]), int(c_ids[some[j]]), float(d[j])) for j in first]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) that
    ``is_query`` selects, by Euclidean distance."""
    rows = stored(usable(vectors))
    n = rows.count()
    router, probes = fit(rows, n, k)
    known = vectors.sparkSession.sparkContext.broadcast(router)
    index = stored(_placed(rows, known, 1))
    queries = stored(_placed(rows.filter(is_query).distinct(), known, probes))
    blocks = lambda df, size, name: df.groupBy("part").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))
    # At most MAX_PARTS rows.
    grid = F.broadcast(blocks(index, BLOCK_ROWS, "cs").join(blocks(queries, BLOCK_QUERIES, "qs"), "part"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda df, own, other, a, b: (df.join(grid, "part").withColumn(a, F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
                                         .withColumn(b, each(other)).select("part", "c", "q", "vec_id", "v"))
    candidates, asked = side(index, "cs", "qs", "c", "q"), side(queries, "qs", "cs", "q", "c")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids = lambda t: t.column("vec_id").to_numpy()
        found = nearest_in(_matrix(right.column("v")), ids(right), _matrix(left.column("v")), ids(left), k)
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*found)) or [[]] * 3, schema.types)], schema=schema)

    keys = ["part", "c", "q"]
    found = (candidates.groupBy(*keys).cogroup(asked.groupBy(*keys))
             .applyInArrow(search, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
