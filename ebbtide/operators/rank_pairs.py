"""Rank correlation of all pairs of columns, each over the rows where both have a value.

The rank of a value depends on the pair, as its rows do, but a sorted column serves all its pairs: one
running count per partner, of the rows where that partner has a value, gives every rank.  So nothing is
laid out per pair of columns:

* Rows are packed into blocks of at most ``BLOCK_ROWS``: order-keeping whole numbers for the values, bits for NULL.
* Each column is cut at splitters taken from its values; a splitter is a cell of its own, and so is each range
  between two.  One pass counts the rows of each cell per partner, which settles the ranks of splitters: all values of
  a column with few, and every value that many rows share.
* Only values inside ranges are exchanged, once per row and column: a range is sorted in one task, and ranks
  within it return to the block of their row, which adds up products of ranks for all pairs.

Ranks are doubled and centred whole numbers, so ties at their average rank are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.lineage import cut_lineage

#: Rows of a block, and rows worked on at once when the ranks of all pairs are multiplied.
BLOCK_ROWS, SLICE_ROWS = 16_384, 1_024
#: Columns with at most so many values have a cell for each; others have ranges of about ``RANGE_ROWS`` rows.
FEW_VALUES, RANGE_ROWS, MOST_RANGES = 256, 20_000, 1_024


def _keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; zeros are equal, NaN comes last."""
    bits = np.ascontiguousarray(x + 0.0).view(np.int64)
    keys = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return np.where(np.isnan(x), np.iinfo(np.int64).max, keys)


def _binary(values: Sequence[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(v).tobytes() for v in values], pa.binary())


def _blocks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(block, keys, has): keys column by column, and a bit per row and column that has a value."""
    width = len(columns)

    def pack(parts: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        has = np.stack([~table.column(c).is_null().to_numpy() for c in range(width)], axis=1)
        keys = [_keys(table.column(c).to_numpy().astype(float)) for c in range(width)]
        return pa.record_batch([pa.array([block], pa.int64()), _binary([np.stack(keys)]), _binary([np.packbits(has, axis=1)])],
                               names=["block", "keys", "has"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK_ROWS - n)
                batch, n = batch.slice(part.num_rows), n + part.num_rows
                held.append(part)
                if n == BLOCK_ROWS:
                    yield pack(held, block)
                    block, held, n = block + 1, [], 0
        if n:
            yield pack(held, block)
    return rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, "block long, keys binary, has binary")


def _arrays(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, keys, has) with a row of ``keys`` and ``has`` per column."""
    for block, keys, has in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "has"))):
        keys = np.frombuffer(keys, dtype=np.int64).reshape(width, -1)
        yield block, keys, _bits(has, width).T


def _bits(has: bytes, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(has, dtype=np.uint8).reshape(-1, -(-width // 8)), axis=1, count=width).astype(bool)


def _splitters(blocks: DataFrame, width: int, ranges: int) -> list[np.ndarray]:
    """Per column all values, if they are few, or values at equal steps of the ranks."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, has in _arrays(batch, width):
                at, values, weights = [], [], []
                for c in range(width):
                    own, many = np.unique(keys[c][has[c]], return_counts=True)
                    if len(own) > FEW_VALUES:
                        own = np.repeat(own, many)
                        many = np.full(FEW_VALUES + 1, len(own) / (FEW_VALUES + 1))
                        own = own[(np.arange(FEW_VALUES + 1) * len(own)) // (FEW_VALUES + 1)]
                    if len(own):
                        at.append(c)
                        values.append(own)
                        weights.append(many.astype(float))
                yield pa.record_batch([pa.array(at, pa.int32()), _binary(values), _binary(weights)], names=["at", "v", "w"])

    def choose(table: pa.Table) -> pa.Table:
        v, w = (np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(c).to_pylist()])
                for c, kind in (("v", np.int64), ("w", float)))
        found = np.unique(v)
        if len(found) > FEW_VALUES:
            order = np.lexsort((w, v))
            share = np.cumsum(w[order]) / w.sum()
            found = np.unique(v[order][np.searchsorted(share, np.arange(1, ranges) / ranges)])
        return pa.table([table.column("at")[:1], _binary([found])], names=["at", "v"])
    drawn = blocks.mapInArrow(draw, "at int, v binary, w binary").groupBy("at").applyInArrow(choose, "at int, v binary")
    known = {r["at"]: np.frombuffer(r["v"], dtype=np.int64) for r in drawn.collect()}  # one row per column
    return [known.get(c, np.zeros(0, dtype=np.int64)) for c in range(width)]


def _cells(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """2k for the range before splitter k, 2k + 1 for the splitter."""
    return np.searchsorted(splitters, keys, side="left") + np.searchsorted(splitters, keys, side="right")


def _counts(blocks: DataFrame, splitters: list[np.ndarray]) -> list[np.ndarray]:
    """Per column the rows of each cell that have a value of each partner."""
    width = len(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2 * len(s) + 1, width), dtype=np.int64) for s in splitters]
        for batch in batches:
            for _, keys, has in _arrays(batch, width):
                for c, cuts in enumerate(splitters):
                    rows = np.flatnonzero(has[c])
                    cell = _cells(keys[c][rows], cuts)
                    for d in range(width):
                        total[c][:, d] += np.bincount(cell[has[d][rows]], minlength=2 * len(cuts) + 1)
        yield pa.record_batch([pa.array(range(width), pa.int32()), _binary(total)], names=["at", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(n, dtype=np.int64) for n in table.column("n").to_pylist())
        return pa.table([table.column("at")[:1], _binary([total])], names=["at", "n"])
    found = blocks.mapInArrow(run, "at int, n binary").groupBy("at").applyInArrow(add, "at int, n binary").collect()
    counts = {r["at"]: np.frombuffer(r["n"], dtype=np.int64).reshape(-1, width) for r in found}  # one row per column
    return [counts.get(c, np.zeros((2 * len(s) + 1, width), dtype=np.int64)) for c, s in enumerate(splitters)]


def _within(blocks: DataFrame, splitters: list[np.ndarray]) -> DataFrame:
    """(block, at, rows, ranks): for rows whose value lies in a range, twice the rank within the range, by partner."""
    width = len(splitters)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, has in _arrays(batch, width):
                for c, cuts in enumerate(splitters):
                    rows = np.flatnonzero(has[c])
                    cell = _cells(keys[c][rows], cuts)
                    inside = np.flatnonzero(cell % 2 == 0)
                    inside = inside[np.argsort(cell[inside], kind="stable")]
                    rows, cell = rows[inside], cell[inside]
                    if not len(rows):
                        continue
                    starts = np.flatnonzero(np.diff(cell, prepend=-1))
                    bits = np.packbits(has[:, rows].T, axis=1)
                    parts = [np.split(x, starts[1:]) for x in (rows.astype(np.uint16), keys[c][rows], bits)]
                    yield pa.record_batch([pa.array(np.full(len(starts), c), pa.int32()), pa.array(cell[starts], pa.int32()),
                                           pa.array(np.full(len(starts), block), pa.int64()), *map(_binary, parts)],
                                          names=["at", "cell", "block", "rows", "keys", "has"])

    def rank(table: pa.Table) -> pa.Table:
        listed = [np.frombuffer(k, dtype=np.int64) for k in table.column("keys").to_pylist()]
        keys = np.concatenate(listed)
        has = _bits(b"".join(table.column("has").to_pylist()), width)
        order = np.argsort(keys, kind="stable")
        before = np.zeros((len(keys) + 1, width), dtype=np.int64)
        np.cumsum(has[order], axis=0, out=before[1:])
        first, last = (np.searchsorted(keys[order], keys, side=s) for s in ("left", "right"))
        ranks = before[first] + before[last]  # twice the smaller ones and once the equal ones
        ranks = np.where(has, ranks, 0).astype(np.uint16 if 2 * len(keys) < 1 << 16 else np.uint32)
        parts = np.split(ranks, np.cumsum([len(k) for k in listed])[:-1])
        return pa.table([table.column("block"), table.column("at"), table.column("rows"), _binary(parts)],
                        names=["block", "at", "rows", "ranks"])
    return blocks.mapInArrow(spread, "at int, cell int, block long, rows binary, keys binary, has binary").groupBy(
        "at", "cell").applyInArrow(rank, "block long, at int, rows binary, ranks binary")


def _products(blocks: DataFrame, within: DataFrame, splitters: list[np.ndarray], ranks: list[np.ndarray]) -> np.ndarray:
    """Per pair the sum of products of ranks, and per column and partner that of squares; ``ranks`` by cell and partner."""
    width = len(splitters)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, has in _arrays(batch, width):
                cells = np.stack([_cells(keys[c], cuts) for c, cuts in enumerate(splitters)]).astype(np.uint16)
                yield pa.record_batch([pa.array([block], pa.int64()), _binary([cells]), _binary([np.packbits(has.T, axis=1)])],
                                      names=["block", "cells", "has"])

    def multiply(own: pa.Table, others: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table([_binary([])], names=["sums"])
        cells = np.frombuffer(own.column("cells")[0].as_py(), dtype=np.uint16).reshape(width, -1)
        has = _bits(own.column("has")[0].as_py(), width)
        inner: dict[int, np.ndarray] = {}
        for at, rows, more in zip(*(others.column(c).to_pylist() for c in ("at", "rows", "ranks"))):
            rows = np.frombuffer(rows, dtype=np.uint16)
            kind = np.uint16 if len(more) == 2 * width * len(rows) else np.uint32
            inner.setdefault(at, np.zeros((len(has), width), dtype=np.uint32))[rows] = np.frombuffer(more, dtype=kind).reshape(-1, width)
        sums = np.zeros((2, width, width))
        for a in range(0, len(has), SLICE_ROWS):
            some = slice(a, a + SLICE_ROWS)
            known = has[some].astype(float)
            r = np.empty((width, len(known), width))  # column, row, partner
            for c in range(width):
                r[c] = ranks[c][cells[c, some]]
                if c in inner:
                    r[c] += inner[c][some]
                r[c] *= known * known[:, c:c + 1]
            sums[0] += np.einsum("inj,jni->ij", r, r)
            sums[1] += np.einsum("inj,inj->ij", r, r)
        return pa.table([_binary([sums])], names=["sums"])
    placed = blocks.mapInArrow(place, "block long, cells binary, has binary")
    sums = placed.groupBy("block").cogroup(within.groupBy("block")).applyInArrow(multiply, "sums binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                own = np.frombuffer(x).reshape(2, width, width)
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([_binary([total])], names=["sums"])
    found = sums.mapInArrow(add, "sums binary").collect()  # one row per task
    return sum((np.frombuffer(r["sums"]).reshape(2, width, width) for r in found), np.zeros((2, width, width)))


def spearman_pairs(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left_column, right_column, rho, rows) of each pair of columns with a row that has both.

    ``rho`` is NULL where a column of the pair has one value only.
    """
    names = sorted(columns)
    blocks = cut_lineage(_blocks(rows, names))
    width, many = len(names), blocks.count() * BLOCK_ROWS
    splitters = _splitters(blocks, width, max(1, min(MOST_RANGES, -(-many // RANGE_ROWS))))
    counts = _counts(blocks, splitters)
    ranks = []
    for n in counts:
        here = n.copy()
        here[::2] = 0  # inside a range the rank there is added
        ranks.append(2 * (np.cumsum(n, axis=0) - n) + here - n.sum(axis=0))
    products, squares = _products(blocks, _within(blocks, splitters), splitters, ranks)
    total = [n.sum(axis=0) for n in counts]
    found = []
    for i in range(width):
        for j in range(i + 1, width):
            if total[i][j]:
                scale = float(np.sqrt(squares[i, j]) * np.sqrt(squares[j, i]))
                found.append((names[i], names[j], float(products[i, j]) / scale if scale else None, int(total[i][j])))
    return rows.sparkSession.createDataFrame(found, "left_column string, right_column string, rho double, rows long")
