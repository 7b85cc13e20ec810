"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Targets: each source's share of the budget by weight, stopped at a multiple of its size; what is cut
off goes to the others by weight until none is above.  That fixed point is a water level: a source
stops when its cap over its weight lies under the level, which one window over the sources finds.

Sampling: a document has the key -ln(u) / w, with u from a hash of its id and text and w its quality
weight; small keys go first.  A source's target first takes complete epochs of all its documents; what
is left is taken in key order up to the budget.  The order is not sorted as a whole: keys fall in
ranges of at most about ``RANGE_ROWS`` rows, range sums place the budget in one range, and only that
range is ordered, so a source that holds a third of all rows never meets in one task.  Ranges are
equal steps of the key's logarithm: a weight only shifts that logarithm, whose density is at most
1/e, so no mixture of weights crowds a range.

Defined cases: a null source is a source of its own, after all others; a null text has size 0 and is
never taken; sources without words have target 0; a null doc_id is hashed like a value; rows that
repeat id and text tie and the order of equal keys is by doc_id, size and text hash; a null or
non-positive weight counts as the least weight; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.common import WORD, text_of
from ebbtide.llm.rows import place_of, placed
from ebbtide.operators.lineage import stored
from ebbtide.operators.ordering import running_totals

#: Rows of one source in a key range, at most and about.
RANGE_ROWS = 2_000
#: Weights of the sources in order of their names, repeating.
CYCLE = (3, 1, 2)
LEAST_WEIGHT = 0.05
SYMBOLS = "0123456789#$%&*!?@^_=+<>{}[]|~/\\"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """Weight of a document from its share of digits and symbols: 1 for plain prose, 0.05 at least."""
    share = F.try_divide(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.length(text))
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - 4 * F.coalesce(share, F.lit(0.0)))


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11).cast("double") + 0.5) / F.lit(2.0 ** 53)
    return F.greatest(-F.ln(u) / weight, F.lit(1e-18))


def steps_of(rows: Column) -> Column:
    """Ranges per unit of the key's logarithm, so that none of them expects over ``RANGE_ROWS`` rows."""
    return F.greatest(F.lit(1.0), F.ceil(rows / F.lit(math.e * RANGE_ROWS)).cast("double"))


def key_range() -> Column:
    return F.floor(F.ln("__key") * F.col("__steps"))


def source_targets(sizes: DataFrame, budget_share: float, max_epochs: float,
                   cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(source, source_size, n_rows) to the same with ``target``; one row for each source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place + 1).cast("int"))
    everything = W.partitionBy()
    cap = F.col("source_size") * F.lit(float(max_epochs))
    fill = W.orderBy("__at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return (sizes.withColumn("__weight", weight).withColumn("__cap", cap)
            .withColumn("__at", F.col("__cap") / F.col("__weight"))
            .withColumn("__budget", F.sum("source_size").over(everything) * F.lit(float(budget_share)))
            .withColumn("__full", F.coalesce(F.sum("__cap").over(fill), F.lit(0.0)))
            .withColumn("__open", F.sum("__weight").over(everything)
                        - F.coalesce(F.sum("__weight").over(fill), F.lit(0.0)))
            # The level if all sources before this one are full and this one is not.
            .withColumn("__level", F.greatest(F.lit(0.0), (F.col("__budget") - F.col("__full")) / F.col("__open")))
            .withColumn("__stops", F.col("__at") <= F.col("__level"))
            .withColumn("__water", F.max(F.when(~F.col("__stops"), F.col("__level"))).over(everything))
            .withColumn("target", F.when(F.col("__stops"), F.col("__cap"))
                        .otherwise(F.least(F.col("__cap"), F.col("__weight") * F.col("__water"))))
            .select("source", "source_size", "n_rows", "target"))


def mix(docs: DataFrame, budget_share: float = 1.5, max_epochs: float = 2.0, seed: int = 8,
        cut_last: bool = True, cycle: tuple[int, ...] = CYCLE, weight: Column | None = None) -> DataFrame:
    """A row for each document: __place, doc_id, source, size, source_size, target, taken, epochs.

    ``taken`` counts words, repeats too; ``cut_last`` cuts the document in which a budget ends,
    otherwise that document is taken whole if most of it fits.  ``weight`` is the quality weight of a
    row, that of its text if none is given.  ``__place`` is that of ``docs``, if it
    has one.
    """
    text = text_of()
    given = quality_weight(text) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(F.lit(LEAST_WEIGHT))
    light = stored(docs.select(
        place_of(docs).alias("__place"), F.col("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"), exponential_key(F.col("doc_id"), text, given, seed).alias("__key"),
        F.xxhash64(text).alias("__text")))
    targets = source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size"),
                                                         F.count("*").alias("n_rows")), budget_share, max_epochs, cycle)
    plan = stored(targets
                  .withColumn("epochs", F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))))
                  .withColumn("__rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
                  .withColumn("__steps", steps_of(F.col("n_rows"))))
    # One row for each source; Spark broadcasts it when it is small and splits hot sources when not.
    same = light["source"].eqNullSafe(plan["source"])
    ranged = (light.join(plan, same).drop(plan["source"])
              .withColumn("__range", key_range()))
    sums = stored(ranged.groupBy("source", "__range").agg(F.sum("size").alias("__sum")))
    sums = running_totals(sums, "__range", {"__sum": F.col("__sum")}, ["source"]).select(
        F.col("source").alias("__source"), F.col("__range").alias("__in"), F.col("lt___sum").alias("__before"), "__sum")
    placed = (ranged.join(sums, ranged["source"].eqNullSafe(sums["__source"]) & (ranged["__range"] == sums["__in"]))
              .drop("__source", "__in")
              .withColumn("__cuts", (F.col("__before") < F.col("__rest"))
                          & (F.col("__before") + F.col("__sum") > F.col("__rest"))))
    inside = (W.partitionBy("source", "__range").orderBy("__key", "doc_id", "size", "__text", "__place")
              .rowsBetween(W.unboundedPreceding, -1))
    room = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), room))
    if not cut_last:
        part = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    cut = placed.filter("__cuts").withColumn("__part", part)
    whole = placed.filter("not __cuts").withColumn(
        "__part", F.when(F.col("__before") + F.col("__sum") <= F.col("__rest"), F.col("size")).otherwise(F.lit(0)))
    return (whole.unionByName(cut)
            .select("__place", "doc_id", "source", "size", "source_size", "target",
                    (F.col("epochs") * F.col("size") + F.col("__part")).cast("long").alias("taken"),
                    (F.col("epochs") + (F.col("__part") > 0).cast("long")).cast("int").alias("copies")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: rows in as many copies as the mix takes them, all columns."""
    rows = placed(docs)
    chosen = mix(rows, cut_last=False, **options).filter("copies > 0").select(
        F.col("__place").alias("__at"), F.col("copies").alias("__copies"))
    joined = rows.join(chosen, F.col("__place") == F.col("__at"))
    return (joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
