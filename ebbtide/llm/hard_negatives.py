"""Hard-negative mining by segment summaries.

Vectors of whole numbers are cut into segments; each segment keeps its mean and the length of what
deviates from it.  Over one segment the inner product of two vectors is the product of their means
(times the length) plus or minus at most the product of their deviations, so the sums over segments
bound a score from both sides.  Bounds start from the whole vector as one segment; pairs that they
cannot decide are refined with segments a quarter as long, and so on, and only those still open
are scored exactly.

Two passes over the table, both in blocks of about ``BLOCK_ROWS`` rows against ``BLOCK_ANCHORS``
anchors: the first finds each anchor's best rows of its label, the second, for the window of scores
that each of these positives opens, the best rows of other labels.  Only the best of each block go
on.  No block depends on how common a label or a vector is.

Defined cases: rows with a null label or vector, null or non-finite components, or components of
``LARGEST`` and more once scaled take no part (so a score of up to 8,192 components is a long); rows
are compared with rows of their length; repeated rows are rows each, and an anchor is only not its
own partner; a null vec_id comes last among equal scores and equal rows go by their place; an
anchor without positives, or a positive whose window is empty, gives no rows; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.rows import placed
from ebbtide.operators.lineage import stored

LARGEST = 2.0 ** 25
#: A segment is cut into so many at the next level, while its parts keep this many components.
FAN, LEAST_SEGMENT = 4, 4
BLOCK_ANCHORS, LEAST_ROWS, BLOCK_ROWS = 1_024, 512, 16_384
#: Rows of a block that are bounded at once, and the share of undecided pairs from which all are computed.
SLICE, DENSE = 2_048, 0.2


@dataclass
class Side:
    """Vectors of one block with their ids and the summaries of each level."""
    place: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    x: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(table: pa.Table, dim: int) -> Side:
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dim)
        ids = np.array([np.iinfo(np.int64).max if v is None else v for v in table.column("vec_id").to_pylist()], dtype=np.int64)
        return Side(table.column("place").to_numpy(), ids, table.column("label").to_numpy(), x, summaries(x))

    def part(self, start: int, stop: int) -> Side:
        cut = slice(start, stop)
        return Side(self.place[cut], self.ids[cut], self.label[cut], self.x[cut], [(m[cut], d[cut]) for m, d in self.levels])


def summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level and segment: mean times the root of the length, and norm of the deviation from the mean."""
    dim, parts, out = x.shape[1], 1, []
    values = x.astype(np.float64)
    while dim and (parts == 1 or dim // parts >= LEAST_SEGMENT):
        edge = np.arange(parts + 1) * dim // parts
        length = np.diff(edge)
        total = np.add.reduceat(values, edge[:-1], axis=1)
        square = np.add.reduceat(values * values, edge[:-1], axis=1)
        out.append((total / np.sqrt(length), np.sqrt(np.maximum(square - total * total / length, 0))))
        parts *= FAN
    return out


def _bounds(a: Side, b: Side, level: int, pairs: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of all pairs, or of those at the places ``pairs``; a little wide, for rounding."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    if pairs is None:
        middle, reach = ma @ mb.T, da @ db.T
    else:
        middle = np.einsum("ij,ij->i", ma[pairs[0]], mb[pairs[1]])
        reach = np.einsum("ij,ij->i", da[pairs[0]], db[pairs[1]])
    reach = reach + 1e-9 * (np.abs(middle) + reach) + 1e-3
    return middle - reach, middle + reach


def _exact(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole inner products of the pairs (i, j)."""
    if not len(i):
        return np.zeros(0, dtype=np.int64)
    most = float(np.abs(a.x).max(initial=0)) * float(np.abs(b.x).max(initial=0)) * max(a.x.shape[1], 1)
    kind = np.float64 if most < 2 ** 53 else np.int64
    if len(i) > DENSE * len(a.x) * len(b.x):
        return (a.x.astype(kind) @ b.x.astype(kind).T)[i, j].astype(np.int64)
    out = np.empty(len(i), dtype=np.int64)
    for at in range(0, len(i), 65_536):
        cut = slice(at, at + 65_536)
        out[cut] = np.einsum("ij,ij->i", a.x[i[cut]].astype(kind), b.x[j[cut]].astype(kind))
    return out


def _first(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each owner, by falling score, then id, then place."""
    order = np.lexsort((place, ids, -score, owner))
    own = owner[order]
    start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.concatenate((start, [len(own)]))))
    return order[rank < k]


def best_in(a: Side, b: Side, low: np.ndarray, high: np.ndarray, same: bool, k: int, tally: dict | None = None) -> tuple:
    """(anchor, window, score, row): for each anchor of ``a`` and window [low, high] of whole scores (columns;
    closed), the first k rows of ``b`` of the same label, but not itself, or of other labels.

    Windows with low > high hold nothing.  ``tally`` counts the pairs that each level decides.
    """
    windows = low.shape[1]
    bar = low.astype(np.float64)  # least score that can still enter
    kept = [np.zeros(0, dtype=np.int64) for _ in range(4)]
    for start in range(0, len(b.x), SLICE):
        part = b.part(start, min(start + SLICE, len(b.x)))
        alive = (a.label[:, None] == part.label[None]) == same
        if same:
            alive &= a.place[:, None] != part.place[None]
        pairs = None
        for level in range(len(part.levels)):
            if pairs is None and alive.sum() <= DENSE * alive.size:
                pairs = np.nonzero(alive)
            least, most = _bounds(a, part, level, pairs)
            before = alive.sum() if pairs is None else len(pairs[0])
            if pairs is None:
                wanted = np.zeros_like(alive)
                for w in range(windows):
                    _raise_bars(bar, w, low, high, np.where(alive, least, -np.inf), most, k)
                    wanted |= (most >= bar[:, w, None]) & (least <= high[:, w, None])
                alive &= wanted
                left = alive.sum()
            else:
                wanted = np.zeros(len(pairs[0]), dtype=bool)
                for w in range(windows):
                    wanted |= (most >= bar[pairs[0], w]) & (least <= high[pairs[0], w])
                pairs = (pairs[0][wanted], pairs[1][wanted])
                left = len(pairs[0])
            if tally is not None:
                tally[level] = tally.get(level, 0) + int(before - left)
        i, j = np.nonzero(alive) if pairs is None else pairs
        score = _exact(a, part, i, j)
        if tally is not None:
            tally["exact"] = tally.get("exact", 0) + len(i)
        for w in range(windows):
            fits = (score >= bar[i, w]) & (score <= high[i, w])
            new = [i[fits] * windows + w, score[fits], part.ids[j[fits]], start + j[fits]]
            kept = [np.concatenate(x) for x in zip(kept, new)]
        first = _first(kept[0], kept[1], kept[2], b.place[kept[3]], k)
        kept = [x[first] for x in kept]
        # A full window's worst score is its bar from now on.
        owner, count = np.unique(kept[0], return_counts=True)
        worst = np.minimum.reduceat(kept[1], np.cumsum(count) - count) if len(owner) else np.zeros(0)
        full = count >= k
        bar[owner[full] // windows, owner[full] % windows] = worst[full]
    return kept[0] // windows, kept[0] % windows, kept[1], kept[3]


def _raise_bars(bar: np.ndarray, w: int, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> None:
    """Lift the bars of window w to the kth lower bound among the pairs that surely lie in it."""
    if least.shape[1] < k:
        return
    sure = np.where((least >= low[:, w, None]) & (most <= high[:, w, None]), least, -np.inf)
    kth = np.partition(sure, least.shape[1] - k, axis=1)[:, least.shape[1] - k]
    np.maximum(bar[:, w], kth, out=bar[:, w])


def usable(vectors: DataFrame, is_anchor: Column, scale: float) -> DataFrame:
    """(place, vec_id, label, dim, x, anchor) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fits = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.lit(float(scale)) * c) < F.lit(LARGEST)), F.lit(False)))
    return (placed(vectors).filter(F.col("label").isNotNull() & F.coalesce(fits, F.lit(False)))
            .select(F.col("__place").alias("place"), F.col("vec_id").cast("long").alias("vec_id"),
                    F.col("label").cast("long").alias("label"), F.size("embedding").alias("dim"),
                    F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c).cast("int")).alias("x"),
                    F.coalesce(is_anchor, F.lit(False)).alias("anchor")))


def _blocks(rows: DataFrame, most: int, least: int) -> int:
    n = rows.count()
    wanted = -(-n // max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    return max(1, -(-n // min(most, max(least, wanted))))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least_share: int = 50,
         most_share: int = 95, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among the
    rows of ``vectors`` (vec_id, embedding, label).

    Scores are inner products of floor(scale * component).  A positive's negatives score from
    ``least_share`` to ``most_share`` hundredths of its score.
    """
    rows = stored(usable(vectors, is_anchor, scale))
    asked = rows.filter("anchor").drop("anchor")
    rows = rows.drop("anchor")
    row_blocks, anchor_blocks = _blocks(rows, BLOCK_ROWS, LEAST_ROWS), _blocks(asked, BLOCK_ANCHORS, BLOCK_ANCHORS)
    block = lambda n: F.pmod(F.xxhash64("place"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by_anchor = lambda df: df.withColumn("ab", block(anchor_blocks)).withColumn("rb", each(row_blocks))
    by_row = rows.withColumn("rb", block(row_blocks)).withColumn("ab", each(anchor_blocks))

    found = pa.schema([("place", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()),
                       ("x", pa.list_(pa.int32())), ("positive_id", pa.int64()), ("score", pa.int64()), ("other", pa.int64())])

    def partners(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found.empty_table()
        dim = left.column("dim")[0].as_py()
        a, b = Side.of(left, dim), Side.of(right, dim)
        edge = np.full((len(a.x), 1), np.iinfo(np.int64).max // 2)
        i, _, score, j = best_in(a, b, -edge, edge, True, positives)
        own = left.select(["place", "vec_id", "label", "dim", "x"]).take(pa.array(i))
        return pa.table([*own.columns, right.column("vec_id").take(pa.array(j)), pa.array(score),
                         pa.array(b.place[j])], schema=found)

    keys = ["dim", "label", "ab", "rb"]
    near = (by_anchor(asked).groupBy(*keys).cogroup(by_row.groupBy(*keys))
            .applyInArrow(partners, "place long, vec_id long, label long, dim int, x array<int>, positive_id long, score long, other long"))
    order = F.row_number().over(W.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "other"))
    near = near.withColumn("rank", order).filter(F.col("rank") <= positives)
    # At most ``positives`` rows for each anchor.
    opened = stored(near.groupBy("place").agg(
        *(F.first(c).alias(c) for c in ("vec_id", "label", "dim", "x")),
        F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("open")))

    result = pa.schema([("place", pa.int64()), ("anchor_id", pa.int64()), ("which", pa.int32()), ("positive_id", pa.int64()),
                        ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64()), ("other", pa.int64())])

    def others(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result.empty_table()
        dim = left.column("dim")[0].as_py()
        a, b = Side.of(left, dim), Side.of(right, dim)
        opens = left.column("open").to_pylist()
        shut = np.iinfo(np.int64).max // 2
        low, high = np.full((len(a.x), positives), shut), np.full((len(a.x), positives), -shut)
        for i, own in enumerate(opens):
            for w, p in enumerate(own):
                least, most = -(-least_share * p["score"] // 100), most_share * p["score"] // 100
                if least <= most:
                    low[i, w], high[i, w] = least, most
        i, w, score, j = best_in(a, b, low, high, False, negatives)
        chosen = [opens[r][c] for r, c in zip(i.tolist(), w.tolist())]
        return pa.table([pa.array(a.place[i]), left.column("vec_id").take(pa.array(i)), pa.array(w, pa.int32()),
                         pa.array([p["positive_id"] for p in chosen], pa.int64()), pa.array([p["score"] for p in chosen], pa.int64()),
                         right.column("vec_id").take(pa.array(j)), pa.array(score), pa.array(b.place[j])], schema=result)

    keys = ["dim", "ab", "rb"]
    mined = (by_anchor(opened).groupBy(*keys).cogroup(by_row.groupBy(*keys))
             .applyInArrow(others, "place long, anchor_id long, which int, positive_id long, positive_score long, "
                                   "negative_id long, negative_score long, other long"))
    order = F.row_number().over(W.partitionBy("place", "which").orderBy(
        F.desc("negative_score"), F.asc_nulls_last("negative_id"), "other"))
    return (mined.withColumn("rank", order).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
