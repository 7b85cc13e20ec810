"""Exact dedup and the n-gram Jaccard join against brute force."""

import hashlib
import random

import pytest

from ebbtide.llm import exact_dedup, jaccard_join
from ebbtide.llm.components import components
from tests.llm.helpers import WHITE, brute_components, documents

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def brute_groups(rows):
    groups = {}
    for place, (doc_id, text) in enumerate(rows):
        body = WHITE.sub("", text or "")
        groups.setdefault(body, []).append((-len(text or ""), doc_id if doc_id is not None else 2 ** 63 - 1, place))
    out = []
    for doc_id, text in rows:
        body = WHITE.sub("", text or "")
        best = min(groups[body])
        out.append((doc_id, None if best[1] == 2 ** 63 - 1 else best[1], len(groups[body]), hashlib.sha256(body.encode()).hexdigest()))
    return out


EDGE = [(1, "a b c"), (2, "ab c"), (3, "a  b\tc "), (4, None), (5, ""), (6, " \n"), (7, "é ü"), (8, "éü"), (8, "éü"),
        (None, "a b c"), (9, LONG), (10, LONG.replace(" ", "\n")), (11, "solo"), (None, None), (12, "a\x0bb\x0cc"), (13, "a bc")]


def sortable(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("capacity", [1, 3, 20_000])
def test_exact_groups(spark, capacity):
    out = exact_dedup.exact_groups(documents(spark, EDGE), capacity).collect()
    assert sortable((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == sortable(brute_groups(EDGE))
    assert sum(r.kept for r in out) == len({r.text_sha256 for r in out})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_dedup_without_memory_for_folding(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FOLD_BYTES", 0)
    rows = EDGE * 3
    out = exact_dedup.exact_groups(documents(spark, rows)).collect()
    assert sortable((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == sortable(brute_groups(rows))


def test_deduplicate_keeps_one_row_and_all_columns(spark):
    docs = documents(spark, EDGE)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert out.count() == len({WHITE.sub("", t or "") for _, t in EDGE})


def test_directory_splits_overfull_buckets():
    counts = {i: 1 for i in range(16)} | {3: 50}
    buckets = exact_dedup.directory(counts, 4, 8)
    assert sum(2 ** (4 - depth) for _, depth in buckets) == 16
    starts = [prefix << (4 - depth) for prefix, depth in buckets]
    assert starts == sorted(starts) and (3, 4) in buckets and (1, 1) in buckets


def near_copies(seed=5):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((1000 - i, " ".join(copy)))
    for i in range(40):
        rows.append((2000 + i, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(5, 40))])))
    for i in range(30):
        rows.append((3000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))))
    rows += [(4000, rows[0][1].upper()), (4001, None), (4002, ""), (4003, "  "), (4004, "one two"), (4005, "ONE two"),
             (4006, "one two three"), (4007, LONG), (4008, LONG + " tail"), (None, rows[3][1]), (None, "only null here and more"),
             (4004, "one two"), (None, None)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"COMMON": 2, "SHORT_LIST": 2, "HUB_PARTNERS": 3}, {"BROADCAST_TOKENS": 5, "COMMON": 1}])
def test_jaccard_components(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies()
    out = jaccard_join.linked_components(documents(spark, rows)).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute_components(rows))]
    assert sortable((r.doc_id, r.n_shingles, r.component_id) for r in out) == sortable(want)


def test_short_lists_are_exchanged_as_they_are(spark):
    """The pairs of short lists by brute force; no entry is multiplied before its exchange."""
    rng = random.Random(3)
    sizes = [rng.choice([1, 2, 7, 40, 44, 50, 52]) for _ in range(50)]
    entries = [(token, place, sizes[place], rng.randrange(sizes[place])) for token in range(200)
               for place in rng.sample(range(50), rng.randint(1, 8))]

    def may_link(x, y):
        (_, _, n, p), (_, _, m, q) = x, y
        return 100 * min(n, m) >= 75 * max(n, m) and min(n - p, m - q) >= -(-(n + m) * 75 // 175)
    want = sorted((x[1], y[1]) for x in entries for y in entries if x[0] == y[0] and x[1] < y[1] and may_link(x, y))
    pairs = jaccard_join._short_pairs(spark.createDataFrame(entries, "token long, __place long, n int, pos int"), 75)
    assert sorted((r.a, r.b) for r in pairs.collect()) == want and want
    plan = pairs._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_long_lists_alone_are_probed_by_blocks(spark, monkeypatch):
    seen, probe = [], jaccard_join._probe
    monkeypatch.setattr(jaccard_join, "_probe", lambda x, y, *more: seen.append(x.count()) or probe(x, y, *more))
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 10_000)
    rows = near_copies(7)
    out = jaccard_join.linked_components(documents(spark, rows)).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute_components(rows))]
    assert sortable((r.doc_id, r.n_shingles, r.component_id) for r in out) == sortable(want)
    assert not any(seen)


def test_one_per_component(spark):
    rows = near_copies(9)
    docs = documents(spark, rows)
    out = jaccard_join.one_per_component(docs)
    groups = jaccard_join.linked_components(docs)
    assert out.columns == docs.columns
    assert out.count() == groups.select("__root").distinct().count()


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 180)] + [(7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 180)}


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.deduplicate(docs).count() == 0
    assert jaccard_join.linked_components(docs).count() == 0
