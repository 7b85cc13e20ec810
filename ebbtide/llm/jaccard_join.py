"""Documents linked by the Jaccard similarity of their word n-grams, as components.

Sets of 64-bit shingle fingerprints are joined by an inverted index over set prefixes, with the two
skips of set relations:

* Long index lists are blocked by position.  A probing set joins only the position blocks in which a
  partner could still reach the threshold if this token is their first common one; others are
  skipped whole, and inside a block the exact bound decides.  The pairs of a short list are all tried.
* Answers are derived from similar sets.  Equal sets are folded to one.  In a long list all sets are
  compared with the list's most central set (the one with the fewest rarer tokens); a set linked to
  it has its answer for this list.  Only sets outside that component then probe the list, and only
  for partners in other components.

Tokens are ordered by frequency class, then by value.  Classes come from counts over all documents:
tokens in more than ``COMMON`` prefixes move behind all others, the tokens that come up for them are
counted in turn, and the most frequent ones are broadcast up to a fixed number.  Any order gives the same
result; a good one keeps lists short.

Candidates are verified on whole texts.  A hub's partners are split over tasks, each with a copy of
the hub's text, and stream past it.

Defined cases: null and empty texts have no set and link with nothing; with fewer words than
``width`` the whole sequence is one shingle; repeated rows are documents of their own; a null doc_id
takes part and never names a component unless all ids in it are null (then null); empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import if_small, plain_bytes, shingle_sets, small_batches, text_blocks, text_of
from ebbtide.llm.components import components
from ebbtide.llm.rows import placed as written
from ebbtide.operators.lineage import stored

#: Prefixes that a token may lie in before it moves behind the rarer ones.
COMMON = 8
#: A set with this share of common tokens in its first prefix has all its tokens counted.
WHOLE_SHARE = 0.25
#: Tokens that are broadcast at most (12 bytes each): the most frequent ones.
BROADCAST_TOKENS = 4_000_000
#: Entries of a list whose pairs are all compared at once; longer lists go by their central set.
SHORT_LIST = 8
#: Partners of one hub that a task compares.
HUB_PARTNERS = 200


def _needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-percent * n // 100)


def _classes(tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Frequency class of each token, 0 if it is not common."""
    known, classes = common
    if not len(known):
        return np.zeros(len(tokens), dtype=np.int8)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, classes[at], 0)


def _prefix(tokens: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first tokens, by class and value, of which two linked sets share at least one."""
    n = len(tokens)
    length = n - _needed(n, percent) + 1 if n else 0
    kind = _classes(tokens, common)
    if not kind.any():
        return tokens[:length]
    return tokens[np.lexsort((tokens, kind))[:length]]


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(__place, __id, n, digest) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "__text"):
            sets = shingle_sets(plain_bytes(block.column("__text")), width)
            yield pa.record_batch([
                block.column("__place"), block.column("__id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())],
                names=["__place", "__id", "n", "digest"])
    return docs.mapInArrow(run, "__place long, __id long, n long, digest binary")


def _counted(docs: DataFrame, width: int, percent: int, first) -> DataFrame:
    """(token, df) of the first prefixes, or, with the common tokens of those, of what comes next.

    Next come the tokens that move up when common ones move behind; of a set that is largely common
    (a near copy of many) all tokens, since any of them may be common too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int8))
        for block in text_blocks(batches, "__text"):
            found = []
            for s in shingle_sets(plain_bytes(block.column("__text")), width):
                prefix = _prefix(s, percent, none)
                if first is not None:
                    common = _classes(prefix, first.value) > 0
                    if not common.any():
                        continue
                    more = s if common.mean() >= WHOLE_SHARE else _prefix(s, percent, first.value)
                    prefix = np.setdiff1d(more, prefix, assume_unique=True)
                found.append(prefix)
            joined = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
            yield pa.record_batch([pa.array(joined.view(np.int64))], names=["token"])
    return docs.select("__text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("df"))


def common_tokens(docs: DataFrame, width: int, percent: int):
    """Broadcast (sorted tokens, frequency classes) of the tokens that many prefixes hold."""
    def sent(held: DataFrame):
        least = COMMON
        while held.filter(F.col("df") > least).count() > BROADCAST_TOKENS:
            least *= 2
        rows = held.filter(F.col("df") > least).toPandas()
        tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        classes = np.floor(np.log2(np.maximum(rows["df"].to_numpy(np.float64)[order], 1))).astype(np.int8)
        return docs.sparkSession.sparkContext.broadcast((tokens[order], classes))

    many = stored(_counted(docs, width, percent, None).filter(F.col("df") > COMMON))
    more = stored(_counted(docs, width, percent, sent(many)).filter(F.col("df") > COMMON))
    return sent(stored(many.union(more).groupBy("token").agg(F.max("df").alias("df"))))


def _entries(docs: DataFrame, width: int, percent: int, common) -> DataFrame:
    """Index entries (token, __place, n, pos) of all prefixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "__text"):
            sets = shingle_sets(plain_bytes(block.column("__text")), width)
            prefixes = [_prefix(s, percent, common.value) for s in sets]
            lengths = np.array([len(p) for p in prefixes], dtype=np.int64)
            if not lengths.sum():
                continue
            places = block.column("__place").to_numpy(zero_copy_only=False)
            yield pa.record_batch([
                pa.array(np.concatenate(prefixes).view(np.int64)), pa.array(np.repeat(places, lengths)),
                pa.array(np.repeat(np.array([len(s) for s in sets], dtype=np.int32), lengths)),
                pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]))],
                names=["token", "__place", "n", "pos"])
    return docs.select("__place", "__text").mapInArrow(run, "token long, __place long, n int, pos int")


def _overlap(nx: Column, ny: Column, percent: int) -> Column:
    """Common tokens that linked sets of these sizes need."""
    return F.ceil((nx + ny) * F.lit(percent) / F.lit(100 + percent))


def _may_link(x: DataFrame | dict[str, Column], y: DataFrame | dict[str, Column], percent: int) -> Column:
    """Size bound, and position bound if this is the first common token."""
    rest = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return ((100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
            & (rest >= _overlap(x["n"], y["n"], percent)))


def _block(pos: Column) -> Column:
    return F.floor(F.log2(pos + F.lit(1.0))).cast("int")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of places, from a stored table, whose sets are linked, by whole texts."""
    hubs = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(HUB_PARTNERS)).cast("int").alias("parts")))
    texts = docs.select("__place", "__text")
    sides = if_small(pairs.join(hubs, "a").select(
        F.col("b").alias("__place"), "a", F.pmod(F.hash("b"), "parts").alias("part"), F.lit(1).alias("turn")), pairs)
    heads = if_small(hubs.select(F.col("a").alias("__place"), F.col("a").alias("__hub"),
                                 F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                 F.lit(0).alias("turn")), hubs)
    rows = (texts.join(heads, "__place").select(F.col("__hub").alias("a"), "part", "turn", "__place", "__text")
            .union(texts.join(sides, "__place").select("a", "part", "turn", "__place", "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, dtype=np.uint64)
        for block in text_blocks(batches, "__text"):
            links = []
            for a, turn, b, s in zip(block.column("a").to_pylist(), block.column("turn").to_pylist(),
                                     block.column("__place").to_pylist(),
                                     shingle_sets(plain_bytes(block.column("__text")), width)):
                if turn == 0:
                    head = s
                    continue
                both = len(np.intersect1d(head, s, assume_unique=True))
                if both and 100 * both >= percent * (len(head) + len(s) - both):
                    links.append((a, b))
            a, b = zip(*links) if links else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return stored(rows.repartition("a", "part").sortWithinPartitions("a", "part", "turn").mapInArrow(run, "a long, b long"))


def linked_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """A row for each document: __place, doc_id, n_shingles, component_id, __root.

    ``__place`` is that of ``docs``, if it has one, and ``__root`` the least place of its component.
    """
    small_batches(docs.sparkSession)
    placed = written(docs).select("__place", F.col("doc_id").cast("long").alias("__id"), text_of().alias("__text"))
    sets = stored(_sets(placed, width))
    # Equal sets: one stands for all; the others need no answers of their own.
    firsts = stored(sets.filter("n > 0").groupBy("digest", "n").agg(F.min("__place").alias("first"), F.count("*").alias("k"))
                    .filter("k > 1").select("digest", "first"))
    folded = stored(sets.join(firsts, "digest").select("__place", "first").filter("__place <> first"))
    left_out = if_small(folded.select("__place").union(sets.filter("n = 0").select("__place")), sets)
    single = placed.join(left_out, "__place", "left_anti")

    common = common_tokens(single, width, percent)
    entries = stored(_entries(single, width, percent, common))
    lists = stored(entries.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"))
    # The lists hold one row for each token, spread by its hash: small hash tables, and no sort of the entries.
    entries = stored(entries.join(lists.hint("shuffle_hash"), "token"))

    pairs = _short_pairs(entries.filter(F.col("size") <= SHORT_LIST), percent)
    long = entries.filter(F.col("size") > SHORT_LIST).withColumn("block", _block(F.col("pos")))
    mids = stored(long.groupBy("token").agg(F.min(F.struct("pos", "n", "__place")).alias("mid"))
                  .select(F.col("token").alias("t"), "mid.pos", "mid.n", "mid.__place"))
    star = (long.join(mids, (long["token"] == mids["t"]) & (long["__place"] != mids["__place"]) & _may_link(long, mids, percent))
            .select(mids["__place"].alias("a"), long["__place"].alias("b")))
    # A pair found from both ends is verified once.
    tried = stored(_once(pairs.union(star)))
    links = verified(tried, placed, width, percent)
    found = components(links)
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(_stray_pairs(long, mids, found, percent).distinct().join(tried, ["a", "b"], "left_anti"))
    links = links.union(verified(more, placed, width, percent)).union(folded.select(F.col("first").alias("a"), F.col("__place").alias("b")))
    roots = components(stored(links))
    rooted = stored(sets.join(roots, sets["__place"] == roots["node"], "left").select(
        "__place", "__id", "n", F.col("comp").alias("__root")))
    # Only linked documents need a name other than their own id; a large component's rows can be split.
    linked = rooted.filter("__root is not null")
    names = stored(linked.groupBy("__root").agg(F.min("__id").alias("name")))
    out = ("__place", F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"))
    return (linked.join(names, "__root").select(*out, F.col("name").alias("component_id"), "__root")
            .union(rooted.filter("__root is null").select(*out, F.col("__id"), F.col("__place"))))


def _once(pairs: DataFrame) -> DataFrame:
    """One of (a, b) and (b, a), keeping the hub in front."""
    return (pairs.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b"))
            .groupBy("low", "high").agg(F.min("a").alias("a")).select(
                "a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")))


def _short_pairs(short: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of places that may link, by all pairs of each short list.

    Such a list has no blocks to skip, so its entries are exchanged as they are, once for both sides.
    """
    x, y = short.alias("x"), short.alias("y")
    side = lambda name: {c: F.col(f"{name}.{c}") for c in ("token", "__place", "n", "pos")}
    a, b = side("x"), side("y")
    return (x.join(y, (a["token"] == b["token"]) & (a["__place"] < b["__place"]) & _may_link(a, b, percent))
            .select(a["__place"].alias("a"), b["__place"].alias("b")))


def _probe(x: DataFrame, y: DataFrame, percent: int, also: Column) -> DataFrame:
    """Join probing entries x with list entries y: only position blocks that can hold a partner.

    A partner of size up to 100 n / percent at position q leaves enough tokens only while
    q <= size - needed, so blocks that start behind the largest such q are skipped.
    """
    most = F.floor(F.lit((10_000 / percent - percent) / (100 + percent)) * x["n"] + 1)
    probing = x.withColumn("to", F.explode(F.sequence(F.lit(0), _block(F.greatest(most, F.lit(0))))))
    return probing.join(y, (probing["token"] == y["token"]) & (probing["to"] == y["block"]) & also & _may_link(x, y, percent))


def _stray_pairs(long: DataFrame, mids: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of long lists that no derived answer covers: from sets outside the component of the
    list's central set to sets of other components."""
    named = long.join(found, long["__place"] == found["node"], "left").select(
        *long.columns, F.coalesce("comp", "__place").alias("comp"))
    heart = mids.join(found, mids["__place"] == found["node"], "left").select(
        F.col("t"), F.coalesce("comp", "__place").alias("heart"))
    known = stored(named.join(heart, named["token"] == heart["t"]).drop("t"))
    x = known.filter("comp <> heart")
    y = known.select(*[F.col(c).alias(c) for c in known.columns])
    return (_probe(x, y, percent, (x["comp"] != y["comp"]) & ((y["comp"] == y["heart"]) | (x["__place"] < y["__place"])))
            .select(F.least(x["__place"], y["__place"]).alias("a"), F.greatest(x["__place"], y["__place"]).alias("b")))


def one_per_component(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One document of each component, all columns."""
    rows = written(docs)
    groups = linked_components(rows, width, percent)
    dropped = stored(groups.filter("__place <> __root").select(F.col("__place").alias("__dropped")))
    return rows.join(if_small(dropped), F.col("__place") == F.col("__dropped"), "left_anti").drop("__place")
