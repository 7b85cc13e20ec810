"""Quality, toxicity, neighbours, URL filters and archives."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import ann, queries, quality, toxicity, url_filters, warc
from tests.conftest import SF
from tests.llm.helpers import documents, saved

BIG = SF.replace("sf0.001", "sf0.1")


def metrics(spark, rows, label, held):
    frame = rows.join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert all((zlib.crc32(str(i).encode()) % held[1] == held[0]) for i in frame.doc_id)
    truth, said = frame[label] == 1, frame.predicted == 1
    return (truth & said).sum() / max(said.sum(), 1), (truth & said).sum() / truth.sum(), (~truth & ~said).sum() / (~truth).sum()


def test_quality_on_held_out_rows(spark):
    precision, recall, rejected = metrics(spark, queries.op3_quality(spark, BIG), "quality", (0, 5))
    assert precision > 0.97 and recall > 0.97 and rejected > 0.9


def test_toxicity_on_held_out_rows(spark):
    precision, recall, _ = metrics(spark, queries.op4_toxicity(spark, BIG), "toxic", (2, 4))
    assert precision > 0.75 and recall > 0.85


def edge_docs(spark):
    return documents(spark, [(1, None), (2, ""), (3, " "), (4, "w" * 50_000), (5, "a b " * 20_000), (None, "x y z"), (6, "one"), (6, "one")])


def test_quality_edges(spark):
    docs = edge_docs(spark)
    positives = spark.createDataFrame([(5,), (6,), (None,), (99,)], "doc_id long")
    rows = quality.scored(docs, positives).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    none = quality.scored(docs, positives.filter("doc_id = 99")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.scored(documents(spark, []), positives).count() == 0
    assert quality.good_documents(docs, positives.filter("doc_id = 99")).columns == docs.columns


def test_only_near_copies_fold_among_labelled_texts(spark):
    """A shared passage is no copy: such texts all stay; of copies with one changed word one stays."""
    shared = " ".join(f"licence{i}" for i in range(30))
    rows = [(i, 0, f"{shared} " + " ".join(f"own{i}x{k}" for k in range(40))) for i in range(60)]
    rows += [(100 + i, 1, " ".join(f"copy{k}" for k in range(200)) + f" last{i}") for i in range(20)]
    rows += [(200, 0, ""), (201, 0, ""), (202, 1, ""), (203, 1, "one"), (203, 1, "one")]
    kept = toxicity._without_copies(spark.createDataFrame(rows, "__known long, __label int, __text string")).collect()
    assert sorted(r[0] for r in kept) == [*range(60), 100, 200, 202, 203]


def test_toxicity_does_not_depend_on_the_order_of_rows(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    one, other = ({r.doc_id: round(r.score, 9) for r in toxicity.passages(d, labels).select("doc_id", "score").collect()}
                  for d in (docs, docs.repartition(7)))
    assert one == other


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 0), (5, 0), (6, 1), (None, 1), (99, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.passages(docs, labels).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.passages(docs, labels.filter("toxic = 0")).collect()} == {0.5}
    assert toxicity.passages(documents(spark, []), labels).count() == 0


def test_features_have_no_odd_values():
    x = quality.features([b"", b" ", b"word", "ÉTÉ!! ÉTÉ!!".encode(), b"a b\na b\na b", b"z" * 10_000])
    assert x.shape == (6, len(quality.NAMES)) and np.isfinite(x).all()


def test_segments_equal_recursive_definition():
    def brute(scores):
        out = []

        def split(a, b):
            best = None
            for i in range(a, b):
                total = 0.0
                for j in range(i, b):
                    total += scores[j]
                    if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                        best = (i, j + 1, total)
            if best:
                split(a, best[0])
                out.append(best)
                split(best[1], b)
        split(0, len(scores))
        return out
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = rng.normal(-0.3, 1, 25)
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute(scores)]
    assert toxicity.segments(np.array([-1.0, -2.0])) == []


def vectors(spark, rows):
    return saved(spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int"))


def brute_nearest(rows, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((c - v) ** 2).sum())), i) for i, c in good if i != q)[:k]
            out[q] = [(n + 1, i, round(d, 9)) for n, (d, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("blocks", [4_000, 3])
def test_nearest_without_parts_is_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(ann, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", blocks)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(250)]
    rows += [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(30)]
    rows += [(300, [0.0] * 4), (400, None), (500, [1.0, None, 0.0, 0.0]), (600, [1.0, float("nan"), 0.0, 0.0]),
             (700, [1.0, 2.0]), (800, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (100, rows[100][1])]
    got = {}
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    want = brute_nearest(rows[:-1], 10)
    assert set(got) == set(want)
    assert all(sorted(got[q]) == want[q] for q in want if q != 100)
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(vectors(spark, rows[:2]), F.col("vec_id") % 100 == 0).count() == 1


def test_learned_parts_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 250)
    frame = spark.read.parquet(f"{BIG}/embeddings.parquet")
    out = ann.nearest(frame, F.col("vec_id") % 100 == 0).toPandas()
    table = frame.toPandas()
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    found = []
    for q, g in out.groupby("query_id"):
        at = np.flatnonzero(ids == q)[0]
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        d[at] = np.inf
        found.append(len(set(ids[np.lexsort((ids, d))[:10]]) & set(g.vec_id)) / 10)
    assert len(found) == (ids % 100 == 0).sum() and np.mean(found) >= 0.9


def test_parts_are_balanced():
    label = ann.balanced_parts(np.random.default_rng(0).normal(size=(500, 8)), 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.min() >= 60 and sizes.max() <= 65


URLS = [(1, "http://A.Example.NET/en/1?x#y"), (2, "https://example.net"), (3, "ftp://example.com/de/"), (4, None), (5, "no scheme"),
        (6, "http://sub.example.org/fr/a/b?c"), (7, "http://badnet/x"), (8, "http://x.net/"), (9, "http://example.com/DE/"),
        (10, "http://h/p#f?g"), (11, "http://?q"), (12, "http://example.net/en"), (None, "http://example.org/fr/"), (1, "http://x.net/")]


def plain_rule(url):
    at = (url or "").find("://")
    host = path = ""
    if at >= 0:
        rest = url[at + 3:]
        end = re.match(r"[^/?#]*", rest).end()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = re.match(r"[^?#]*", rest[end:]).group()
    best = None
    for rule, action in queries.URL_RULES:
        name, slash, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + prefix) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return host, path, best


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>", "x") for i, u in URLS], "page_id long, url string, html string, host string")
    out = url_filters.judged(saved(pages), queries.URL_RULES).collect()
    want = [(i, *plain_rule(u)) for i, u in URLS]
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in out), key=repr)
    assert got == sorted(((i, h, p, b[0] if b else None) for i, h, p, b in want), key=repr)
    ruled = {b[0]: b[1] for *_, b in want if b}
    assert all(r.verdict == ruled[r.rule] for r in out if r.rule)
    assert all(r.verdict in ("allow", "block") for r in out)


def test_templates_generalise_merge_and_reject(spark):
    rows = [("h", f"/shop/{i}", 1, 1, 0) for i in range(40)] + [("h", f"/news/{i}", 1, 0, 1) for i in range(40)]
    rows += [("h", f"/blog/{i}", 1, 0, 1) for i in range(40)] + [("h", f"/open/{i}", 1, 0, 0) for i in range(10)]
    rows += [("h", "/a/b/c/d/e/f/g/h", 1, 0, 0), ("", "", 3, 0, 0)]
    paths = spark.createDataFrame(rows, "host string, path string, n long, blocked long, allowed long")
    found = {r.path: r.template for r in url_filters.templates(paths).collect()}
    assert found["/shop/1"] == "/shop/*" and found["/open/3"] == "/open/*" and found[""] == ""
    assert found["/news/2"] == found["/blog/2"] == "/~allow/*"
    assert found["/a/b/c/d/e/f/g/h"].count("/") == url_filters.MAX_DEPTH + 1
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, *_) in enumerate(rows)], "page_id long, url string")
    labels = paths.select("host", "path", "blocked", "allowed")
    verdicts = {r.path: r.verdict for r in url_filters.judged(pages, [], labels).collect()}
    assert verdicts["/shop/5"] == "block" and verdicts["/news/5"] == "allow" and verdicts["/open/5"] == "allow"
    assert url_filters.judged(pages.limit(0), queries.URL_RULES).count() == 0


PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u\r\nWARC-Type: x", ""), (5, "http://c/", "é\r\n\r\nWARC/1.1 x"),
         (6, "http://d/", "long " * 100_000), (0, "http://e/", "same"), (None, "http://f/", "same"), (None, "http://g/", "alone"), (7, "http://h/", "é\r\n\r\nWARC/1.1 x")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "FILE_BYTES", 60)
    pages = saved(spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload_bytes int"))
    out = warc.archive(pages, least).collect()
    assert len(out) == len(PAGES)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        lead = first.get(html or "")
        revisit = len(body) >= least and lead is not None and i != lead
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response",
                     lead if revisit else None, None if revisit else body))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.archive(pages.limit(0)).count() == 0


def test_normalised_members_stand_alone(spark, tmp_path):
    folder = f"file://{tmp_path}"
    pages = saved(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    members = warc.normalise(warc.write_archives(warc.decide(pages), folder), folder)
    import gzip
    import json
    n = 0
    for r in members.collect():
        raw = (tmp_path / r["file"]).read_bytes()
        lines = [json.loads(x) for x in (tmp_path / r["index"]).read_text().splitlines()]
        n += len(lines)
        assert sum(x["length"] for x in lines) == len(raw)
        for x in lines:
            member = gzip.decompress(raw[x["offset"]:x["offset"] + x["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and x["record"].encode() in member and member.endswith(b"\r\n\r\n")
    assert n == len(PAGES)
