"""Fixture tables and brute-force forms of the operators."""

from __future__ import annotations

import collections
import re
import tempfile
import uuid

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, size string, cuts int"


def documents(spark, rows):
    """(doc_id, text[, source]) as a stored table with extra columns of clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 7, "y", 3) for r in rows]
    return saved(spark.createDataFrame(full, DOCS))


def saved(df):
    path = f"{tempfile.gettempdir()}/ebbtide-test-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows):
    """Place in ``rows`` to (set size, least doc_id of its component)."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(len(sets[i]), least[find(i)]) for i in range(len(rows))]


def targets(sizes, share=1.5, most=2.0, cycle=(3, 1, 2)):
    """Source to target, by handing out the excess again until no source is above its cap."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: cycle[i % len(cycle)] for i, n in enumerate(names)}
    rest, left, out = share * sum(sizes.values()), set(names), {}
    while left:
        total = sum(weight[n] for n in left)
        over = [n for n in left if rest * weight[n] / total > most * sizes[n] + 1e-9]
        if not over:
            out |= {n: rest * weight[n] / total for n in left}
            break
        out |= {n: most * sizes[n] for n in over}
        rest -= sum(most * sizes[n] for n in over)
        left -= set(over)
    return out
