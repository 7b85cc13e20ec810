"""Quality classifier by positive-unlabelled learning.

Each text has a fixed number of features from its bytes and words: over the whole text, and the
most extreme of its windows of ``WINDOW`` words, so a junk passage in a good text shows.  A linear
score g on these features minimises the non-negative unbiased risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)]) + L2

with the logistic loss, trusted positives (labelled good) and all texts as the unlabelled web text;
labelled bad texts are never used as such.  The risk is convex, so Newton steps on sums over all
rows reach the minimum in a few jobs; once the bracket is negative its part of the step is turned
round, as the non-negative estimator asks.  The class prior is estimated from a first fit: the least
ratio, over score thresholds, of the unlabelled share above it to the positive share above it.

Only sums over features leave the tasks.  Terms are rounded to whole multiples of a power of two, so
that their sums are exact and no cut of the table into files or tasks changes a model or a score;
scores have nine decimals.  Positives are bounded by ``MAX_POSITIVES``, a sample by hash of the
doc_id that does not change with the order of rows.

Defined cases: null and empty texts have the features of no words and get a score like any other;
repeated rows count each; without positives every score is 0.5; rows with a null doc_id carry no
label; labels that name an unknown doc_id count for nothing; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import byte_kinds, if_small, plain_bytes, small_batches, text_blocks, text_of, word_hashes, word_spans
from ebbtide.llm.rows import place_of, placed
from ebbtide.operators.lineage import stored

WINDOW = 40
MAX_POSITIVES = 200_000
STEPS = 12
L2 = 1e-3
CLIP = 6.0
#: Byte kinds whose share is a feature, as in ``common.byte_kinds``.
KINDS = ("upper", "digit", "symbol", "stop", "high")
RATES = (*KINDS, "length", "repeat", "near_repeat", "distinct", "bare")
NAMES = tuple(f"{n}_{part}" for n in RATES for part in ("all", "most", "least")) + ("log_words", "line_repeat")


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    hashes, counts = word_hashes(texts)
    starts, ends, raw = word_spans(texts)
    n = len(texts)
    out = np.zeros((n, len(NAMES)), dtype=np.float32)
    out[:, -2] = np.log1p(counts)
    for i, text in enumerate(texts):
        lines = [line for line in text.split(b"\n") if line.strip()]
        out[i, -1] = 1 - len(set(lines)) / len(lines) if lines else 0
    if not len(hashes):
        return out
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    text_of_word = np.repeat(np.arange(n), counts)
    at = np.arange(len(hashes)) - first[text_of_word]
    # The last window of a text takes the words that are too few for one of their own.
    windows = np.maximum(counts // WINDOW, 1)
    base = np.concatenate(([0], np.cumsum(windows)[:-1]))
    window = base[text_of_word] + np.minimum(at // WINDOW, windows[text_of_word] - 1)
    total = int(windows.sum())

    length = (ends - starts).astype(np.float64)
    per_word = []
    for kind in KINDS:
        flags = np.concatenate(([0], np.cumsum(byte_kinds(kind)[raw])))
        per_word.append((flags[ends] - flags[starts]).astype(np.float64))
    letters = length - per_word[1] - per_word[2] - per_word[3]
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text_of_word[1:] == text_of_word[:-1])
    order = np.lexsort((hashes, window))
    fresh = np.ones(len(hashes))
    fresh[order[1:]] = (hashes[order[1:]] != hashes[order[:-1]]) | (window[order[1:]] != window[order[:-1]])
    bare = (letters <= 0).astype(np.float64)

    def rates(group: np.ndarray, size: int) -> np.ndarray:
        total_of = lambda x: np.bincount(group, weights=x, minlength=size)
        words, chars = np.maximum(np.bincount(group, minlength=size), 1), np.maximum(total_of(length), 1)
        shares = [total_of(x) / chars for x in per_word]
        return np.stack([*shares, np.log1p(chars / words), total_of(same) / words,
                         1 - total_of(fresh) / words, total_of(fresh) / words, total_of(bare) / words], axis=1)

    whole = rates(text_of_word, n)
    parts = rates(window, total)
    owner = np.repeat(np.arange(n), windows)
    edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    out[:, 0:3 * len(RATES):3] = whole
    out[:, 1:3 * len(RATES):3] = np.maximum.reduceat(parts, edge, axis=0)
    out[:, 2:3 * len(RATES):3] = np.minimum.reduceat(parts, edge, axis=0)
    out[counts == 0, :3 * len(RATES)] = 0
    return out


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "__text"):
            rows = features(plain_bytes(block.column("__text")))
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel(), pa.float32()), len(NAMES))
            yield pa.record_batch([block.column("__place"), block.column("__id"),
                                   values.cast(pa.list_(pa.float32()))], names=["__place", "__id", "x"])
    return docs.mapInArrow(run, "__place long, __id long, x array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


#: Bits behind the point in the terms of sums: of inputs, of probabilities and losses, of plain features.
INPUT_BITS, SHARE_BITS, FEATURE_BITS = 12, 20, 20
#: Batches whose totals, each under 2^53, a task adds up before it hands them on.
FLUSH = 512


def whole(x: np.ndarray, bits: int) -> np.ndarray:
    """The nearest multiples of 2^-bits, as whole numbers in double precision."""
    return np.rint(x * float(1 << bits))


def _sums(rows: DataFrame, contribution) -> np.ndarray:
    """Sum over all rows of the vector of whole numbers that ``contribution(x, positive)`` gives for a batch.

    All additions are exact: in a batch below 2^53, over batches in longs, over tasks as decimals.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = None, 0
        for batch in batches:
            if batch.num_rows:
                part = contribution(matrix(batch.column("x")), batch.column("positive").to_numpy(zero_copy_only=False))
                total = part.astype(np.int64) if total is None else total + part.astype(np.int64)
                held += 1
            if held == FLUSH:
                yield pa.record_batch([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["k", "v"])
                total, held = None, 0
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["k", "v"])
    found = (rows.mapInArrow(run, "k long, v long").groupBy("k")
             .agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("v")).toPandas())
    return found.sort_values("k")["v"].astype(float).to_numpy()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Standardised linear score; ``prior`` is the estimated share of good texts."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return weighed(self.inputs(x), self.weights)


def weighed(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """z @ weights, column by column: a row's sum does not depend on the rows beside it."""
    out = np.zeros(len(z))
    for k, weight in enumerate(weights):
        out += z[:, k] * weight
    return out


def _descend(rows: DataFrame, model: Model, prior: float, n_pos: float, n_all: float) -> Model:
    """Newton steps on the non-negative risk; each is one job over all rows."""
    d = len(model.weights)
    for _ in range(STEPS):
        def parts(x: np.ndarray, positive: np.ndarray, model=model) -> np.ndarray:
            z = model.inputs(x)
            g = weighed(z, model.weights)
            s, p = sigmoid(g), positive.astype(np.float64)
            soft = whole(np.maximum(g, 0) - np.log(sigmoid(np.abs(g))), SHARE_BITS)
            spread = whole(z * np.sqrt(s * (1 - s))[:, None], INPUT_BITS)
            z, s = whole(z, INPUT_BITS), whole(s, SHARE_BITS)
            h, hp = spread.T @ spread, (spread * p[:, None]).T @ spread
            return np.concatenate([[soft.sum(), (p * soft).sum()], s @ z, p @ z, (p * s) @ z, h.ravel(), hp.ravel()])
        v = _sums(rows, parts)
        if not len(v):
            break
        unit = 2.0 ** -INPUT_BITS
        v = v * np.concatenate([np.full(2, 2.0 ** -SHARE_BITS), np.repeat([unit * 2.0 ** -SHARE_BITS, unit,
                                unit * 2.0 ** -SHARE_BITS], d), np.full(2 * d * d, unit * unit)])
        soft_all, soft_pos = v[0] / n_all, v[1] / n_pos
        u, zp, sp = v[2:2 + d] / n_all, v[2 + d:2 + 2 * d] / n_pos, v[2 + 2 * d:2 + 3 * d] / n_pos
        h_all, h_pos = (v[2 + 3 * d:].reshape(2, d, d)[k] / n for k, n in ((0, n_all), (1, n_pos)))
        bracket = soft_all - prior * soft_pos
        # gradient of prior E_pos[loss(g)] and of the bracket
        g_pos, g_neg = prior * (sp - zp), u - prior * sp
        sign = 1.0 if bracket >= 0 else -1.0
        penalty = L2 * np.r_[0.0, np.ones(d - 1)]
        gradient = g_pos + sign * g_neg + penalty * model.weights
        hessian = (h_all if sign > 0 else prior * h_pos + h_all) + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(np.linalg.norm(step), 1e-12))
        model = Model(model.mean, model.scale, model.weights - step, prior)
        if np.abs(step).max() < 1e-4:
            break
    return model


def _estimated_prior(rows: DataFrame, model: Model, n_pos: float, n_all: float, bins: int = 1000) -> float:
    """Least ratio of the shares above a score, unlabelled to positive, where positives are many."""
    def counts(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        k = np.minimum((sigmoid(model.margin(x)) * bins).astype(int), bins - 1)
        return np.concatenate([np.bincount(k, minlength=bins), np.bincount(k[positive], minlength=bins)]).astype(np.float64)
    v = _sums(rows, counts)
    above = lambda c: np.cumsum(c[::-1])[::-1]
    q_all, q_pos = above(v[:bins]) / n_all, above(v[bins:]) / n_pos
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(n_all) + 1 / np.sqrt(n_pos))
    bound = np.where(q_pos > 0.05, (q_all + slack * 0.1) / np.maximum(q_pos, 1e-9), np.inf)
    return float(np.clip(bound.min(), 0.05, 0.99))


def fit(rows: DataFrame) -> Model | None:
    """Fit on rows (x, positive); None without positives."""
    def moments(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        w = whole(x, FEATURE_BITS)
        return np.concatenate([[len(x), positive.sum()], w.sum(0), whole(x * x, FEATURE_BITS).sum(0)])
    v = _sums(rows, moments)
    if not len(v) or v[1] < 1:
        return None
    v[2:] /= 1 << FEATURE_BITS
    n_all, n_pos = v[0], v[1]
    mean, square = v[2:2 + len(NAMES)] / n_all, v[2 + len(NAMES):] / n_all
    scale = np.sqrt(np.maximum(square - mean * mean, 1e-8))
    start = Model(mean, scale, np.zeros(1 + 2 * len(NAMES)), 0.5)
    first = _descend(rows, start, 0.5, n_pos, n_all)
    prior = _estimated_prior(rows, first, n_pos, n_all)
    return _descend(rows, start, prior, n_pos, n_all)


def scored(docs: DataFrame, positives: DataFrame) -> DataFrame:
    """(__place, doc_id, score) of every document; ``positives`` (doc_id) are trusted good texts.

    ``__place`` is that of ``docs``, if it has one.
    """
    base = docs.select(place_of(docs).alias("__place"), F.col("doc_id").cast("long").alias("__id"),
                       text_of().alias("__text"))
    small_batches(docs.sparkSession)
    # Least hashes first keeps the same sample at any order of rows; its size is the documented bound.
    chosen = (positives.select(F.col("doc_id").cast("long").alias("__pos")).filter("__pos is not null").distinct()
              .orderBy(F.xxhash64("__pos"), "__pos").limit(MAX_POSITIVES))
    found = stored(_featured(base))
    rows = stored(found.join(F.broadcast(chosen), F.col("__id") == F.col("__pos"), "left")
                  .select("__place", "__id", "x", F.col("__pos").isNotNull().alias("positive")))
    model = fit(rows.select("x", "positive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = (sigmoid(model.margin(matrix(batch.column("x")))) if model is not None and batch.num_rows
                     else np.full(batch.num_rows, 0.5))
            yield pa.record_batch([batch.column("__place"), batch.column("__id"), pa.array(np.round(score, 9), pa.float64())],
                                  names=["__place", "doc_id", "score"])
    return rows.select("__place", "__id", "x").mapInArrow(run, "__place long, doc_id long, score double")


def held_out(remainder: int, modulus: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``remainder``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def good_documents(docs: DataFrame, positives: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents with a score of ``least`` or more, all columns."""
    rows = placed(docs)
    dropped = stored(scored(rows, positives).filter(F.col("score") < least).select(F.col("__place").alias("__dropped")))
    return rows.join(if_small(dropped), F.col("__place") == F.col("__dropped"), "left_anti").drop("__place")
