"""Byte-level BPE with given ranks, and decoding.

Each match of the splitting pattern is merged on its own.  Its byte positions are the leaves of a
segment tree; a leaf has the rank of the pair that starts there, an inner node the least rank
below it and, of equal ranks, the leftmost.  A merge reads the root, joins the pair, and updates
the leaves of the live neighbours, each in logarithmic time; a piece of n bytes costs O(n log n).

Defined cases: null and empty texts have no tokens and decode to no bytes; text of any length is
encoded whole; repeated rows are encoded alike; other columns may be carried along unread.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import small_batches, text_blocks, text_of

#: Distinct pieces in each generation of a worker's memory.
REMEMBERED_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece by least-rank, leftmost-first merges."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    none = len(ranks) + (1 << 32)
    # A node is rank * width + position, so the least node is the least rank, leftmost.
    width = size
    absent = none * width
    tree = [absent] * (2 * size)
    end, previous = list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(at: int) -> int:
        middle = end[at]
        if middle >= n:
            return absent
        rank = ranks.get(piece[at:end[middle]])
        return absent if rank is None else rank * width + at

    for at in range(n - 1):
        tree[size + at] = pair(at)
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right

    def put(at: int, value: int) -> None:
        node = size + at
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left <= right else right
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    while tree[1] < absent:
        at = tree[1] % width
        gone = end[at]
        end[at] = end[gone]
        if end[at] < n:
            previous[end[at]] = at
        put(gone, absent)
        put(at, pair(at))
        if previous[at] >= 0:
            put(previous[at], pair(previous[at]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:end[at]]])
        at = end[at]
    return ids


class PieceMemory(dict):
    """Pieces to their ids as little-endian unsigned 32-bit integers, in two generations.

    When the young one is full it becomes the old one, and what is still asked for moves back; so at
    most twice ``REMEMBERED_PIECES`` are held and frequent pieces stay.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(merge_piece(piece.encode(), self.ranks), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


#: The memory of this Python worker, kept over its tasks: ranks file and pieces.
_kept: list = [None, None]


def _memory(ranks_path: str, ranks: dict[bytes, int]) -> PieceMemory:
    if _kept[0] != ranks_path:
        _kept[:] = [ranks_path, PieceMemory(ranks)]
    return _kept[1]


class Vocabulary:
    """Bytes of all tokens end to end, to decode arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


#: What the operator can return for each text, with its type.
OUTPUTS = {"token_ids": "array<int>", "decoded": "binary", "n_tokens": "long",
           "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, outputs: list[str],
                  keep: list[str]) -> DataFrame:
    """Encode every text and decode the ids again; returns ``keep`` columns and ``outputs``.

    The ranks file is read once by the driver and broadcast (a vocabulary, of fixed size).
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    with_ranks = context.broadcast(read_ranks(ranks_path))
    kept = [F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = with_ranks.value
        memory, vocabulary = _memory(ranks_path, ranks), Vocabulary(ranks)
        pieces = regex.compile(pattern).findall
        for block in text_blocks(batches, "__text"):
            columns: dict[str, list] = {name: [] for name in outputs}
            for text in block.column("__text").to_pylist():
                ids = b"".join(map(memory.__getitem__, pieces(text)))
                if "token_ids" in columns:
                    columns["token_ids"].append(np.frombuffer(ids, dtype="<i4"))
                if "n_tokens" in columns:
                    columns["n_tokens"].append(len(ids) // 4)
                if "ids_sha256" in columns:
                    columns["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                if "decoded" in columns or "decoded_sha256" in columns:
                    body = vocabulary.decode(ids)
                    if "decoded" in columns:
                        columns["decoded"].append(body)
                    if "decoded_sha256" in columns:
                        columns["decoded_sha256"].append(hashlib.sha256(body).hexdigest())
            types = {"token_ids": pa.list_(pa.int32()), "decoded": pa.binary(), "n_tokens": pa.int64(),
                     "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            yield pa.record_batch([block.column(i) for i in range(len(keep))]
                                  + [pa.array(columns[name], types[name]) for name in outputs],
                                  names=[f"__keep_{i}" for i in range(len(keep))] + outputs)

    schema = ", ".join([f"__keep_{i} {kinds[c]}" for i, c in enumerate(keep)]
                       + [f"{name} {OUTPUTS[name]}" for name in outputs])
    out = docs.select(*kept, text_of().alias("__text")).mapInArrow(run, schema)
    return out.select(*[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)], *outputs)
