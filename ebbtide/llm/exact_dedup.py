"""Exact duplicates by an extendible-hash index on shared files.

The leading bits of a 64-bit hash of the normalised text address a directory of 2^depth slots.  A
bucket that holds more distinct keys than its capacity is split on one more bit, and the directory
doubles when a bucket as deep as itself splits.  Depths come from exact counts of distinct keys per
prefix, so every bucket file is written once, by the task that owns its key range.  In a bucket,
entries of one key form a chain; texts are compared byte by byte with the heads of their chain.

Copies inside one input partition are folded to one carrier row before the shuffle, so a text that
a third of all rows share travels once per partition and never meets in one task.

Defined cases: a null text counts as empty, and empty texts are equal; repeated rows are members
like any others (of equal length and doc_id, any one stays, they are the same); a null doc_id sorts
after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import WHITE, if_small, small_batches, text_blocks, text_of
from ebbtide.llm.rows import place_of, placed
from ebbtide.operators.lineage import shared_folder, stored

#: Distinct keys that a bucket may hold before it splits: a share of all keys within these limits.
LEAST_KEYS, MOST_KEYS, BUCKETS = 1_500, 100_000, 64
#: Bytes of texts that a task keeps for folding copies; rows beyond it travel as carriers.
FOLD_BYTES = 24_000_000
NULL_ID = 2 ** 63 - 1


def directory(counts: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int]]:
    """Grow the directory by splits: (prefix, depth) of each bucket, in key order.

    ``counts`` has the distinct keys of each prefix of ``bits`` bits.
    """
    total = np.zeros((1 << bits) + 1, dtype=np.int64)
    for prefix, n in counts.items():
        total[prefix + 1] = n
    total = np.cumsum(total)
    buckets, waiting = [], [(0, 0)]
    while waiting:
        prefix, depth = waiting.pop()
        low, high = prefix << (bits - depth), (prefix + 1) << (bits - depth)
        if depth < bits and total[high] - total[low] > capacity:
            waiting += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
        else:
            buckets.append((prefix, depth))
    return buckets


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A member row for each document, and per partition one carrier for each distinct text.

    A carrier holds the normalised bytes, the members folded into it and the best of them.
    """
    drop = WHITE.encode()
    heads: dict[bytes, list] = {}
    kept = 0

    def carriers(entries: list[list]) -> pa.RecordBatch:
        body, digest, n, chars, ident, row = zip(*entries)
        key = [int.from_bytes(d[:8], "big", signed=True) for d in digest]
        return pa.record_batch([pa.array(v, t) for v, t in (
            (row, pa.int64()), (ident, pa.int64()), (chars, pa.int64()), (digest, pa.binary()),
            (key, pa.int64()), (n, pa.int64()), (body, pa.binary()))], names=FOLDED_NAMES)

    for batch in text_blocks(batches, "__text"):
        digests, loose = [], []
        for row, ident, chars, text in zip(*(batch.column(c).to_pylist() for c in
                                             ("__row", "__id", "__chars", "__text"))):
            body = text.encode().translate(None, drop)
            digest = hashlib.sha256(body).digest()
            digests.append(digest)
            head = heads.get(digest)
            if head is not None and head[0] == body:
                head[2] += 1
                if (-chars, ident, row) < (-head[3], head[4], head[5]):
                    head[3:] = [chars, ident, row]
            elif head is None and kept < FOLD_BYTES:
                heads[digest] = [body, digest, 1, chars, ident, row]
                kept += len(body) + 300
            else:
                loose.append([body, digest, 1, chars, ident, row])
        n = batch.num_rows
        empty = lambda t: pa.nulls(n, t)
        yield pa.record_batch([batch.column("__row"), batch.column("__id"), batch.column("__chars"),
                               pa.array(digests, pa.binary()), empty(pa.int64()), empty(pa.int64()),
                               empty(pa.binary())], names=FOLDED_NAMES)
        if loose:
            yield carriers(loose)
    entries = list(heads.values())
    heads.clear()
    for at in range(0, len(entries), 500):
        yield carriers(entries[at:at + 500])


FOLDED = "__row long, __id long, __chars long, __digest binary, __key long, __n long, __body binary"
FOLDED_NAMES = [field.split()[0] for field in FOLDED.split(", ")]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carriers sorted by key to one row for each distinct text: chain by key, compare bytes."""
    key, bucket, chain, done = None, None, [], []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * 6
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.record_batch([pa.array(v, t) for v, t in zip(columns, kinds)],
                               names=["__digest", "__keep", "__keep_row", "__size", "__link", "__bucket"])

    def close() -> None:
        done.extend([e[1], e[4], e[5], e[2], link, bucket] for link, e in enumerate(chain))

    for batch in text_blocks(batches, "__body"):
        for k, b, *entry in zip(*(batch.column(c).to_pylist() for c in (
                "__key", "__bucket", "__body", "__digest", "__n", "__chars", "__id", "__row"))):
            if k != key or b != bucket:
                close()
                key, bucket, chain = k, b, []
            for head in chain:
                if head[0] == entry[0]:
                    head[2] += entry[2]
                    if (-entry[3], entry[4], entry[5]) < (-head[3], head[4], head[5]):
                        head[3:] = entry[3:]
                    break
            else:
                chain.append(entry)
        yield flush()
        done.clear()
    close()
    yield flush()


INDEX = "__digest binary, __keep long, __keep_row long, __size long, __link int, __bucket int"


def build_index(carriers: DataFrame, capacity: int | None = None) -> tuple[DataFrame, str]:
    """Write the index of the carriers, one folder for each bucket, and read it back.

    One row for each distinct text: digest, the member that stays, group size, place in its chain.
    """
    spark = carriers.sparkSession
    keys = carriers.select("__key").distinct()
    n = keys.count()
    capacity = capacity or min(MOST_KEYS, max(LEAST_KEYS, n // BUCKETS))
    bits = max(1, int(np.ceil(np.log2(max(1, n / capacity)))) + 3)
    prefix = F.shiftrightunsigned(F.col("__key"), 64 - bits)
    counts = {r[0]: r[1] for r in keys.groupBy(prefix.alias("p")).count().collect()}
    buckets = directory(counts, bits, capacity)
    # Directory slots in key order; a bucket of lesser depth fills several slots.
    slots = [i for i, (_, depth) in enumerate(buckets) for _ in range(1 << (bits - depth))]
    slot_table = spark.createDataFrame(pa.table({"__slot": pa.array(range(1 << bits), pa.int64()),
                                                 "__bucket": pa.array(slots, pa.int32())}))
    path = f"{shared_folder(spark)}/hash-index-{uuid.uuid4().hex}"
    # At most 16 slots for each full bucket; past 2^16 slots the join shuffles.
    placed = (carriers.withColumn("__slot", prefix)
              .join(F.broadcast(slot_table) if bits <= 16 else slot_table, "__slot").drop("__slot"))
    owned = (placed.repartition(max(1, len(buckets)), "__bucket").sortWithinPartitions("__bucket", "__key")
             .mapInArrow(_chains, INDEX))
    owned.write.partitionBy("__bucket").parquet(path)
    return spark.read.schema(INDEX).parquet(path), path


def _grouped(docs: DataFrame, capacity: int | None, id_column: str) -> DataFrame:
    small_batches(docs.sparkSession)
    light = docs.select(place_of(docs).alias("__row"),
                        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("__id"),
                        F.length(text_of()).cast("long").alias("__chars"), text_of().alias("__text"))
    folded = stored(light.mapInArrow(_fold, FOLDED))
    index, _ = build_index(folded.filter("__body is not null"), capacity)
    return (folded.filter("__body is null").select("__row", "__id", "__digest")
            .join(index.drop("__bucket", "__link"), "__digest"))


def exact_groups(docs: DataFrame, capacity: int | None = None, id_column: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    plain = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return _grouped(docs, capacity, id_column).select(
        plain("__id").alias(id_column), plain("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"), (F.col("__row") == F.col("__keep_row")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, capacity: int | None = None, id_column: str = "doc_id") -> DataFrame:
    """The documents that stay, all columns."""
    rows = placed(docs)
    dropped = stored(_grouped(rows, capacity, id_column)
                     .filter(F.col("__row") != F.col("__keep_row"))
                     .select(F.col("__row").alias("__dropped")))
    return rows.join(if_small(dropped), F.col("__place") == F.col("__dropped"), "left_anti").drop("__place")
