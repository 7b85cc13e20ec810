"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are lower-cased letter runs and their first four, five and six bytes (stems, so inflected
forms share evidence).  A token's score is its log-odds between toxic and other labelled texts with
an informative Dirichlet prior: prior counts follow the token's frequency in the whole corpus.
A text counts once for each token it holds, so a repeated word is no more evidence than one, and of
near copies among the labelled texts (sketches of their shingles agree to three quarters) one counts.
Tokens whose likelihood ratio is not beyond what chance gives among all tested tokens score a small negative background value.

A linear scan keeps all maximal segments (runs that no extension or cut improves).  Scores of
segments follow an extreme-value law under the background: with m tokens the expected number of
segments of score S or more is E = K m exp(-lambda S), lambda from the background's score
distribution and K from the number of segments, both on labelled clean texts that the scores used there
have not learned from.  Segments with E below ``LEVEL`` are
significant; a text's evidence is the sum of -ln E over them, and a one-dimensional logistic fit on
the labelled rows turns evidence into a probability.

Labelled rows are bounded by ``MAX_LABELLED`` (a sample by hash of doc_id), so the tokens that can
be significant are bounded too; corpus counts, background and scan cover all texts.

Defined cases: null and empty texts have no segment and the score of no evidence; labels that are
null or name an unknown doc_id count for nothing; without labels of both kinds every score is 0.5;
repeated rows count each in the corpus and once, by their highest evidence, in the fit; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import letter_runs, mix64, plain_bytes, shingle_sets, small_batches, text_blocks, text_of
from ebbtide.operators.lineage import stored

MAX_LABELLED = 200_000
STEM_BYTES = (4, 5, 6)
#: Weight of the prior, as a share of the labelled texts.
PRIOR_SHARE = 0.02
#: Score of tokens without significant log-odds; bins of the score histogram.
BACKGROUND = -0.2
BINS, TOP_SCORE = 400, 20.0
LEVEL = 0.05
#: Rounds of folding near copies among the labelled rows, ranges of a sketch, share that must agree.
ROUNDS = 4
SKETCH, ALIKE = 64, 0.75


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time; end exclusive.

    Only positive runs open candidates, so the loop visits positive tokens alone.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    # Candidate: [left sum, right sum, start, end, index of the last candidate with a smaller left sum].
    held: list[list] = []
    for at in positive.tolist():
        now = [total[at], total[at + 1], at, at + 1, -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= now[0]:
                j = held[j][4]
            now[4] = j
            if j < 0 or held[j][1] >= now[1]:
                held.append(now)
                break
            now = [held[j][0], now[1], held[j][2], now[3], -1]
            del held[j:]
    return [(start, end, right - left) for left, right, start, end, _ in held]


def _token_counts(texts: list[bytes], groups: list[int], n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (words and stems) of a block and, for each group of texts, how many texts hold them."""
    kinds, counts = letter_runs(texts, STEM_BYTES)
    ends = np.cumsum(counts)
    per_text = [np.unique(np.concatenate([tokens[e - n:e] for tokens in kinds])) for e, n in zip(ends.tolist(), counts.tolist())]
    which = np.repeat(np.array(groups, dtype=np.int64), [len(x) for x in per_text])
    tokens = np.concatenate(per_text) if per_text else np.zeros(0, dtype=np.uint64)
    keys, inverse = np.unique(tokens, return_inverse=True)
    found = np.bincount(inverse * n_groups + which, minlength=len(keys) * n_groups)
    return keys, found.reshape(len(keys), n_groups).astype(np.int64)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Least hash of each of ``SKETCH`` ranges of the hashes, 0 where a range is empty."""
    ordered = np.sort(mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93)))
    starts = np.arange(SKETCH, dtype=np.uint64) * np.uint64(2 ** 64 // SKETCH)
    at = np.searchsorted(ordered, starts)
    ends = np.append(at[1:], len(ordered))
    out = np.zeros(SKETCH, dtype=np.uint64)
    out[at < ends] = ordered[at[at < ends]]
    return out


def _alike(a: str, b: str) -> Column:
    """Whether two sketches agree in a share ``ALIKE`` of the ranges that either of them fills."""
    number = lambda test: F.size(F.filter(F.zip_with(a, b, test), lambda x: x))
    return (number(lambda x, y: (x == y) & (x != 0))
            >= F.lit(ALIKE) * number(lambda x, y: (x != 0) | (y != 0)))


def _without_copies(labelled: DataFrame) -> DataFrame:
    """(__known, __label) of labelled texts, one of each group of near copies.

    Copies are no evidence of their own: every word of a toxic text copied a hundred times would
    look toxic.  Near copies mostly share the least of a random order of their shingles: in
    ``ROUNDS`` rounds with other orders a text gives way to the first text with the same least, if
    their whole sketches agree too; texts that share some passage only all stay.  Of rows that share a doc_id
    one decides.
    """
    names = [f"k{i}" for i in range(ROUNDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "__text"):
            sets = shingle_sets(plain_bytes(block.column("__text")), 3)
            least = np.zeros((len(sets), ROUNDS), dtype=np.uint64)
            for row, s in enumerate(sets):
                for i in range(ROUNDS):
                    least[row, i] = mix64(s ^ np.uint64((i * 0x9E3779B97F4A7C15) % 2 ** 64)).min() if len(s) else 0
            sketches = [_sketch(s).view(np.int64) for s in sets]
            yield pa.record_batch([block.column("__known"), block.column("__label"),
                                   pa.array(sketches, pa.list_(pa.int64())),
                                   *[pa.array(least[:, i].view(np.int64)) for i in range(ROUNDS)]],
                                  names=["__known", "__label", "sketch", *names])
    rows = labelled.mapInArrow(run, ", ".join(["__known long, __label int, sketch array<long>", *[f"{k} long" for k in names]]))
    rows = (rows.groupBy("__known", "__label").agg(F.min(F.struct("sketch", *names)).alias("s"))
            .select("__known", "__label", "s.*"))
    for key in names:  # at most MAX_LABELLED rows
        first = F.min(F.struct("__known", "sketch")).over(Window.partitionBy(key, "__label"))
        rows = (rows.withColumn("first", first)
                .filter((F.col("first.__known") == F.col("__known")) | ~_alike("sketch", "first.sketch")).drop("first"))
    return stored(rows.select("__known", "__label"))


#: Groups of texts: unlabelled, then clean and toxic ones of the two halves of the labelled rows.
GROUPS = ("n_none", "n_clean_0", "n_clean_1", "n_toxic_0", "n_toxic_1")


def _counts(docs: DataFrame) -> DataFrame:
    """Documents that hold each token, by group; __group is an index into GROUPS."""
    schema = ", ".join(["token long", *[f"{g} long" for g in GROUPS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "__text"):
            keys, n = _token_counts(plain_bytes(block.column("__text")), block.column("__group").to_pylist(), len(GROUPS))
            yield pa.record_batch([pa.array(keys.view(np.int64)), *[pa.array(n[:, k]) for k in range(len(GROUPS))]],
                                  names=["token", *GROUPS])
    return (docs.select("__text", "__group").mapInArrow(run, schema)
            .groupBy("token").agg(*[F.sum(c).alias(c) for c in GROUPS]))


def log_odds(counts: DataFrame, totals: dict[str, int], halves: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Significant tokens, sorted, and their log-odds, learned from these halves of the labelled rows."""
    names = {kind: [f"n_{kind}_{h}" for h in halves] for kind in ("clean", "toxic")}
    n = {kind: float(sum(totals[c] for c in names[kind])) for kind in names}
    if not n["clean"] or not n["toxic"]:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    y = {kind: sum((F.col(c) for c in names[kind]), F.lit(0)) for kind in names}
    weight = PRIOR_SHARE * (n["clean"] + n["toxic"])
    prior = sum((F.col(c) for c in GROUPS), F.lit(0)) / F.lit(float(sum(totals.values()))) * F.lit(weight)
    toxic, clean = y["toxic"] + prior, y["clean"] + prior
    # Half a document keeps tokens of all documents finite.
    odds = lambda seen, of: F.ln(seen / (F.lit(of + weight + 0.5) - seen))
    seen = counts.filter(y["toxic"] + y["clean"] > 0)
    # Of many tested tokens some look special by chance: the bar is the largest |z| to expect of noise.
    bar = float(np.sqrt(2 * np.log(max(seen.count(), 2))))
    share = (y["toxic"] + y["clean"]) / F.lit(n["toxic"] + n["clean"])
    part = lambda seen, of: F.when(seen > 0, seen * F.ln(seen / (F.lit(of) * share))).otherwise(F.lit(0.0))
    rest = lambda seen, of: F.when(F.lit(of) > seen, (F.lit(of) - seen) * F.ln(
        (F.lit(of) - seen) / (F.lit(of) * (1 - share)))).otherwise(F.lit(0.0))
    ratio = 2 * (part(y["toxic"], n["toxic"]) + part(y["clean"], n["clean"]) + rest(y["toxic"], n["toxic"]) + rest(y["clean"], n["clean"]))
    known = (seen.withColumn("score", odds(toxic, n["toxic"]) - odds(clean, n["clean"]))
             .withColumn("z", F.sqrt(F.greatest(ratio, F.lit(0.0)))).filter(F.col("z") >= bar).select("token", "score"))
    rows = known.toPandas()  # bounded: significant tokens of at most MAX_LABELLED texts
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.clip(rows["score"].to_numpy(np.float64)[order], -TOP_SCORE, TOP_SCORE)


def token_scores(texts: list[bytes], known: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all tokens of a block, and tokens per text."""
    kinds, counts = letter_runs(texts, STEM_BYTES)
    best = np.zeros(len(kinds[0]))
    if not len(known):
        return best + BACKGROUND, counts

    def look(tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        return np.where(known[at] == tokens, odds[at], 0.0)
    for tokens in kinds:
        score = look(tokens)
        best = np.where(np.abs(score) > np.abs(best), score, best)
    return np.where(best > 0, best, np.minimum(best, 0) + BACKGROUND), counts


def _segment_table(docs: DataFrame, known) -> DataFrame:
    """(__place, __id, __label, tokens, starts, ends, sums) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "__text"):
            scores, counts = token_scores(plain_bytes(block.column("__text")), *known.value)
            ends = np.cumsum(counts)
            found = [segments(scores[e - n:e]) for e, n in zip(ends.tolist(), counts.tolist())]
            column = lambda k, t: pa.array([[s[k] for s in x] for x in found], pa.list_(t))
            yield pa.record_batch([block.column("__place"), block.column("__id"), block.column("__label"),
                                   pa.array(counts, pa.int64()), column(0, pa.int32()), column(1, pa.int32()),
                                   column(2, pa.float64())],
                                  names=["__place", "__id", "__label", "tokens", "starts", "ends", "sums"])
    return docs.mapInArrow(run, "__place long, __id long, __label int, tokens long, starts array<int>, "
                                "ends array<int>, sums array<double>")


def _histogram(docs: DataFrame, known) -> np.ndarray:
    """Token scores of these texts in bins from -TOP_SCORE to TOP_SCORE."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for block in text_blocks(batches, "__text"):
            scores, _ = token_scores(plain_bytes(block.column("__text")), *known.value)
            at = np.clip(((scores + TOP_SCORE) / (2 * TOP_SCORE) * BINS).astype(int), 0, BINS - 1)
            total += np.bincount(at, minlength=BINS)
        yield pa.record_batch([pa.array(np.arange(BINS)), pa.array(total)], names=["bin", "n"])
    rows = docs.mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BINS)
    out[rows["bin"].to_numpy()] = rows["n"]
    return out


def decay(histogram: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1 for the background's token scores."""
    share = histogram / max(histogram.sum(), 1)
    s = (np.arange(BINS) + 0.5) / BINS * 2 * TOP_SCORE - TOP_SCORE
    low, high = 0.0, 8.0
    excess = lambda x: float(share @ np.exp(np.minimum(x * s, 600))) - 1
    if not (share @ s < 0) or excess(high) < 0:
        return high if share @ s < 0 else 1.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic fit."""
    z, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - y) + 1e-3 * w)
        step *= min(1.0, 3 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0))


def passages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(__place, doc_id, score, passages) of every document; ``labels`` (doc_id, toxic) to learn from.

    ``passages`` are the significant segments: first and last token, score and E-value.
    """
    small_batches(docs.sparkSession)
    some = (labels.select(F.col("doc_id").cast("long").alias("__known"), F.col("toxic").cast("int").alias("__label"))
            .filter("__known is not null and __label in (0, 1)").groupBy("__known").agg(F.max("__label").alias("__label"))
            .orderBy(F.xxhash64("__known"), "__known").limit(MAX_LABELLED))
    base = docs.select(F.monotonically_increasing_id().alias("__place"), F.col("doc_id").cast("long").alias("__id"),
                       text_of().alias("__text"))
    some = F.broadcast(_without_copies(base.join(F.broadcast(some), F.col("__id") == F.col("__known"))
                                       .select("__known", "__label", "__text")))
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("__known")), F.lit(2)).cast("int")
    base = (base.join(some, F.col("__id") == F.col("__known"), "left")
            .withColumn("__group", F.when(F.col("__label").isNull(), 0).otherwise(1 + 2 * F.col("__label") + half))
            .drop("__known"))
    context = docs.sparkSession.sparkContext
    totals = {g: 0 for g in GROUPS} | {GROUPS[r[0]]: r[1] for r in base.groupBy("__group").count().collect()}
    counts = stored(_counts(base))
    known = context.broadcast(log_odds(counts, totals, (0, 1)))
    # The law of the background comes from clean texts that the scores have not learned from.
    apart = context.broadcast(log_odds(counts, totals, (0,)))
    fresh = base.filter("__group = 2")
    rate = decay(_histogram(fresh.select("__text"), apart))
    # K: such texts should hold as many segments above any score as the law expects.
    clean = _segment_table(fresh, apart).agg(
        F.sum("tokens").alias("m"), F.sum(F.size("sums")).alias("n")).first()
    law = max((clean["n"] or 0) + 1.0, 1.0) / max(clean["m"] or 0, 1.0)
    found = stored(_segment_table(base, known))
    expected = lambda s: F.lit(law) * F.col("tokens") * F.exp(-F.lit(rate) * s)
    listed = F.filter(F.transform(F.arrays_zip("starts", "ends", "sums"), lambda x: F.struct(
        x["starts"].alias("first"), (x["ends"] - 1).alias("last"), x["sums"].alias("sum"),
        expected(x["sums"]).alias("expected"))), lambda x: x["expected"] < LEVEL)
    evidence = F.aggregate("passages", F.lit(0.0), lambda a, x: a + F.least(F.lit(50.0), -F.ln(F.greatest(x["expected"], F.lit(1e-300)))))
    marked = stored(found.withColumn("passages", listed).withColumn("evidence", F.ln(1 + evidence))
                    .select("__place", "__id", "__label", "passages", "evidence"))
    # At most MAX_LABELLED rows, in one order.
    fit = (marked.filter("__label is not null").groupBy("__id", "__label").agg(F.max("evidence").alias("evidence"))
           .toPandas().sort_values("__id"))
    if fit["__label"].nunique() < 2:
        score = F.lit(0.5)
    else:
        a, b = _logistic(fit["evidence"].to_numpy(np.float64), fit["__label"].to_numpy(np.float64))
        score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("evidence"))))
    return marked.select("__place", F.col("__id").alias("doc_id"), score.alias("score"), "passages")
