"""Each stage of the pipeline on what its predecessor kept, and the registered queries."""

import base64
import collections
import hashlib
import re
import struct

import __spark_entry__ as entry
import corpus_pipeline
from ebbtide.llm import mixing, quality, queries
from tests.conftest import SF
from tests.llm.helpers import WHITE, brute_components, documents, saved
from tests.oracle import compare, connect


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_against_brute_force(spark):
    import pytest
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "source_mixing", "byte_bpe"]

    good = saved(stages["quality_classifier"](spark, documents, SF))
    scores = quality.scored(documents, queries.good_examples(spark, SF))
    assert good.columns == documents.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.filter("score >= 0.3").collect()}

    single = saved(stages["exact_dedup"](spark, good, SF))
    best = {}
    for r in good.collect():
        key = WHITE.sub("", r.text or "")
        best[key] = min(best.get(key, (1, 0, 0)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in single.collect()) == sorted(x[-1] for x in best.values())

    apart = saved(stages["ngram_jaccard_join"](spark, single, SF))
    listed = [(r.doc_id, r.text) for r in single.collect()]
    component = dict(zip((i for i, _ in listed), brute_components(listed)))
    groups = collections.Counter(component[i][1] for i, _ in listed)
    kept = collections.Counter(component[r.doc_id][1] for r in apart.collect())
    assert set(kept) == set(groups) and set(kept.values()) == {1}

    mixed = saved(stages["source_mixing"](spark, apart, SF))
    plan = {r.doc_id: r.copies for r in mixing.mix(apart, cut_last=False).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == plan
    assert mixed.columns == documents.columns

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in mixed.collect():
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, r.source, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert rows_of(stages["byte_bpe"](spark, mixed, SF)) == sorted(want, key=repr)


def test_run_gives_the_rows_of_its_stages(spark):
    first, second = corpus_pipeline.run(spark, SF), entry.queries()["pipeline"](spark, SF)
    assert first.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows_of(first) == rows_of(second) and first.count() > 0


def test_rows_keep_their_place_when_the_table_is_cut_anew(spark):
    from ebbtide.llm import exact_dedup, jaccard_join, pii
    rows = [(i, " ".join(f"w{i // 3 * 3 + (k == 40) * (i % 3)}x{k}" for k in range(60)) + f" a{i // 3}@b.cc {'# 9' * (i % 5)}")
            for i in range(90)] + [(100 + i, f"same {i % 7}") for i in range(35)]
    docs = documents(spark, rows)
    positives = spark.createDataFrame([(i,) for i in range(0, 90, 2)], "doc_id long")
    key = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(key, "8")
        scores = {r.doc_id: r.score for r in quality.scored(docs, positives).collect()}
        least = sorted(scores.values())[60]
        spans = {r.doc_id: len(r.base) for r in pii.find_spans(docs).collect()}
        out = [f() for f in (
            lambda: exact_dedup.deduplicate(docs), lambda: jaccard_join.one_per_component(docs),
            lambda: quality.good_documents(docs, positives, least), lambda: mixing.mixed_documents(docs),
            lambda: pii.sanitise(docs), lambda: pii.find_spans(docs))]
        copies = {r.doc_id: r.copies for r in mixing.mix(docs, cut_last=False).collect() if r.copies}
        # The jobs from here on see one partition where the ones before saw eight.
        spark.conf.set(key, "1")
        single, apart, good, mixed, clean, found = [f.collect() for f in out]
    finally:
        spark.conf.unset(key)
    assert sorted(r.doc_id for r in single) == list(range(90)) + list(range(100, 107))
    component = dict(zip((i for i, _ in rows), brute_components(rows)))
    assert sorted(component[r.doc_id][1] for r in apart) == sorted({c for _, c in component.values()})
    assert {r.doc_id for r in good} == {i for i, s in scores.items() if s >= least}
    assert collections.Counter(r.doc_id for r in mixed) == copies
    assert {r.doc_id: len(r.base) for r in found} == spans
    assert all(("[EMAIL]" in r.text) == (r.doc_id < 90) and "@" not in r.text for r in clean)


def test_registered_queries():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_queries_equal_their_sql(spark):
    con = connect(SF)
    from ebbtide.llm.oracle_sql import SQL
    for name, sql in SQL.items():
        assert compare(spark, con, entry.queries()[name], sql, SF) is None, name


def test_quality_scores_do_not_depend_on_the_cut_of_the_table(spark):
    docs = documents(spark, [(i, " ".join(f"w{(i * 7 + k) % 50}{'#9'[: i % 3]}" for k in range(5 + i % 60))) for i in range(300)])
    positives = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    scores = [{r.doc_id: r.score for r in quality.scored(part, positives).collect()}
              for part in (docs.repartition(7), docs.repartition(1), docs.orderBy(-docs.doc_id))]
    assert scores[0] == scores[1] == scores[2] and len(set(scores[0].values())) > 50
