"""Shared pieces: tables, words, fingerprints and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a task works on at once; a longer text is a block of its own.
BLOCK_BYTES = 400_000
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ``BATCH_ROWS`` texts where the session has Spark's default.

    A default batch of long texts takes tens of MB in the JVM and as much in each Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def if_small(df: DataFrame, counted: DataFrame | None = None, rows: int = 1_000_000) -> DataFrame:
    """Broadcast a table of narrow rows when it, or a stored table with at least as many rows, counts
    under the bound; else leave the join to shuffle."""
    return F.broadcast(df) if (df if counted is None else counted).count() <= rows else df


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
                block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that the texts of one slice hold about ``block_bytes``.

    What earlier batches took is handed back to the system, so a worker holds little between tasks.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        sizes = np.array([0 if n is None else n for n in
                          pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + block_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 2 ** 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """First n powers modulo 2^64; the longest table is kept up to a million entries."""
    have = _POWER_CACHE.get(base)
    if have is None or len(have) < n:
        have = _powers(base, max(n, 1 << 16))
        if n <= 1_000_000:
            _POWER_CACHE[base] = have
    return have[:n]


def _kind_table(members: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in members]] = 1
    return out


_KIND = {"upper": _kind_table(UPPER), "digit": _kind_table("0123456789"),
         "symbol": _kind_table("#$%&*@^_=+<>{}[]|~/\\!"), "stop": _kind_table(".,;:?()'\"-"),
         "high": (np.arange(256) >= 128).astype(np.int64)}


def byte_kinds(name: str) -> np.ndarray:
    """Table of the bytes of a kind."""
    return _KIND[name]


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the joined bytes of a block, and these bytes."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    white = _IS_WHITE[raw]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2], raw


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) of a block of texts, and words per text."""
    starts, ends, raw = word_spans(texts)
    values = _BYTE[_FOLD[raw]]
    values *= powers(_MUL, len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * powers(_INV, len(raw))[starts]
                   + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.searchsorted(starts, np.cumsum(lengths))
    return hashes, np.diff(np.concatenate(([0], bounds)))


_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[[ord(c) for c in UPPER + LOWER]] = True
_IS_LETTER[128:] = True


def letter_runs(texts: list[bytes], stems: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all runs of letters (A-Z lower-cased, bytes over 127 are letters), then for each
    length in ``stems`` of their first bytes (of shorter runs, of the whole run); runs per text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    letter = _IS_LETTER[raw]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if letter[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    values = _BYTE[_FOLD[raw]]
    values *= powers(_MUL, len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    back = powers(_INV, len(raw))[starts]
    words = mix64((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64))
    out = [words]
    for k, stem in enumerate(stems, 1):
        cut = np.minimum(ends, starts + stem)
        out.append(mix64((total[cut] - total[starts]) * back + np.uint64(k << 40)))
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.searchsorted(starts, np.cumsum(lengths))
    return out, np.diff(np.concatenate(([0], bounds)))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit fingerprints of its word shingles.

    A text with fewer words than ``width`` has its whole sequence as one shingle, a text without
    words has none.
    """
    words, counts = word_hashes(texts)
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    n = max(len(words) - width + 1, 0)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled = rolled * step + words[k:k + n]
    rolled = mix64(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            out.append(np.unique(rolled[at:at + count - width + 1]))
        elif count:
            value = np.uint64(count)
            with np.errstate(over="ignore"):
                for word in words[at:at + count]:
                    value = value * step + word
            out.append(mix64(np.array([value], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += count
    return out


def plain_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type)
                                          else pa.binary()).to_pylist()]
