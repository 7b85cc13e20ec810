"""Tokens, mixing and personal data against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import byte_bpe, mixing, pii
from tests.llm.helpers import WORD, documents, targets

TEXTS = ["", None, "Hello, world's  best\n\ntest 123 ", "éàü ñ 日本語 \U0001f600", " " * 5000, "a" * 3000, "ab" * 2000,
         "x\ty\r\nz  ", "’quotes’ don't we'll", "\x00\x01 odd", "Ouwhea the of rend and threlyes"]


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks, P


def test_encode_decode_equals_the_library(spark, encoding):
    own, _, P = encoding
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abcdetioné \n.'9") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    docs = documents(spark, list(enumerate(texts)))
    out = byte_bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, list(byte_bpe.OUTPUTS), ["doc_id", "text"]).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = own.encode_ordinary(r.text or "")
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_merge_takes_leftmost_least_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 300, b"ab": 299, b"aab": 301, b"aaaa": 302}

    def plain(piece):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.get(a + b, 10 ** 9), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(10 ** 9, 0))
            if best[0] == 10 ** 9:
                return [ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("aab") for _ in range(rng.randint(1, 40))).encode()
        if piece not in ranks:
            assert byte_bpe.merge_piece(piece, ranks) == plain(piece)


def mix_rows(seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
    return rows + [(400, None, "s1"), (401, "", None), (402, "lone words here", None), (None, "no id", "s2"),
                   (5, "same id", "s2"), (403, None, "empty"), (404, "é ü", "é"), (405, "big " * 500, "Z")]


@pytest.mark.parametrize("range_rows", [10, 10_000])
def test_mix_meets_targets(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    rows = mix_rows()
    docs = documents(spark, rows)
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    plain = lambda rs: sorted(((r.doc_id, r.source, r.size, r.target, r.taken) for r in rs), key=repr)
    assert plain(out) == plain(again) and len(out) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(sizes)
    taken = collections.Counter()
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mix_prefers_small_keys_and_complete_epochs(spark):
    """Every document of a source has all complete epochs; the rest follows the exponential keys."""
    out = mixing.mix(documents(spark, mix_rows())).collect()
    for r in out:
        epochs = int(r.target // r.source_size) if r.source_size else 0
        assert r.taken >= epochs * r.size


@pytest.mark.parametrize("range_rows", [5, 10_000])
def test_mix_takes_documents_in_key_order(spark, monkeypatch, range_rows):
    """Brute force over all documents of a source, with a weight column of its own."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    docs = documents(spark, mix_rows()).withColumn("w", F.when(F.col("doc_id") % 4 == 0, 0.05).when(F.col("doc_id") % 4 == 1, 3.0))
    out = mixing.mix(docs, weight=F.col("w")).collect()
    given = F.coalesce(F.col("w"), F.lit(mixing.LEAST_WEIGHT))
    text = F.coalesce("text", F.lit(""))
    keys = {(r.doc_id, r.source, r.size): r.key for r in docs.select("doc_id", "source", mixing.n_words(text).alias("size"), (
        mixing.exponential_key(F.col("doc_id"), text, given, 8)).alias("key")).collect()}
    groups = collections.defaultdict(list)
    for r in out:
        groups[r.source].append((keys[r.doc_id, r.source, r.size], r))
    for rows in groups.values():
        rows.sort(key=lambda x: x[0])
        first = rows[0][1]
        epochs = int(first.target // first.source_size) if first.source_size else 0
        left = int(first.target - epochs * first.source_size + 1e-9)
        for _, r in rows:
            part = min(r.size, left)
            assert r.taken == epochs * r.size + part
            left -= part


def test_no_mixture_of_weights_crowds_a_key_range(spark):
    rows = 200_000
    weight = F.when(F.col("id") % 3 > 0, mixing.LEAST_WEIGHT).otherwise(1.0)
    keyed = spark.range(rows).select(mixing.exponential_key(F.lit(None).cast("long"), F.col("id").cast("string"), weight, 8)
                                     .alias("__key"), mixing.steps_of(F.lit(rows)).alias("__steps"))
    largest = keyed.groupBy(mixing.key_range()).count().agg(F.max("count")).first()[0]
    assert largest < 1.2 * mixing.RANGE_ROWS


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark, mix_rows())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = mixing.mix(docs, cut_last=False).agg(F.sum("copies")).first()[0]
    assert mixed.count() == copies


def test_quality_weight_orders_junk_last(spark):
    rows = spark.createDataFrame([("plain words",), ("#### $$$$ 1234",), ("",)], "text string")
    got = [r[0] for r in rows.select(mixing.quality_weight(F.col("text"))).collect()]
    assert got[0] == 1.0 and got[1] == 0.05 and got[2] == 1.0


PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(zip(pii.KINDS, PLAIN)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, all(int(x) <= 255 for x in m.group().split(".")) if kind == 1 else False,
                    16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15)[kind]
            if good:
                out.append(f"{name}:{m.start()}:{m.end()}")
    return ",".join(out)


PII_TEXTS = [
    "a@b.com_c@d.org 1.2.3.4.5.6.7.8 999.1.1.1 +1 (234) 567-8901 x", "4111 1111 1111 1111 and 4111-1111-1111-11112",
    "1 " * 9000 + "4111111111111111", None, "", "é@x.y a@x.y ü +49 30 1234567.", "0004.0255.256.1 00000000001.2.3.4",
    "a@b a@b. a@b.c.d- x@y.z@w.v", "+1+2+3 12345678 +12345678", "9" * 25 + " 4111-1111 1111-1111", "1.2.3 4.5.6.7",
    "%%a@b.cc,,b@c.dd;e@f.gg", "4111 1111  1111 1111 1111"]


def test_base_spans_equal_plain_patterns(spark):
    docs = documents(spark, list(enumerate(PII_TEXTS)))
    out = pii.find_spans(docs).select("doc_id", pii.listed(F.col("base")).alias("spans")).collect()
    assert {r.doc_id: r.spans for r in out} == {i: base_spans(t or "") for i, t in enumerate(PII_TEXTS)}


def test_query_counts_each_kind(spark, tmp_path):
    from ebbtide.llm.queries import op9_pii
    texts = [*PII_TEXTS, "a@b.com b@c.com 1.2.3.4", "4111111111111111 +1 234 567 8901 +1 234 567 8902"]
    documents(spark, list(enumerate(texts))).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(
        f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op9_pii(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        plain = base_spans(text or "")
        kinds = [span.split(":")[0] for span in plain.split(",")]
        assert [out[i][f"n_{name}"] for name in pii.KINDS] == [kinds.count(name) for name in pii.KINDS]
        assert out[i].base_sha256 == hashlib.sha256(plain.encode()).hexdigest()


def test_long_runs_are_scanned_in_linear_time(spark):
    docs = documents(spark, [(1, "a" * 200_000 + " " + "9" * 200_000 + "." + "1-" * 100_000 + " a@x.y")])
    out = pii.find_spans(docs).select(pii.listed(F.col("base")).alias("spans")).first()
    assert out.spans.endswith("email:600002:600007") or "email" in out.spans


def test_disclosing_terms_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        noise = " ".join(rng.choice(["alpha", "bravo", "delta", "gamma", "house"]) for _ in range(12))
        if i % 10 == 0:
            rows.append((i, f"{noise} Zyzzyva, mail boss@corp.example (Quixote) {noise}"))
        else:
            rows.append((i, noise))
    docs = documents(spark, rows)
    out = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    for i, text in rows:
        words = {text[s["start"]:s["end"]].lower() for s in out[i].added}
        assert words == ({"zyzzyva", "mail", "quixote"} if i % 10 == 0 else set())
        assert all(s["how"] == "remove" for s in out[i].added)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "Zyzzyva" not in clean[0] and clean[1] == rows[1][1]
    assert pii.sanitise(docs).columns == docs.columns


def disclosing_by_brute_force(rows):
    """Per row the (start, end, share) of disclosing words, by whole documents."""
    n, df, de, co = len(rows), collections.Counter(), collections.Counter(), collections.Counter()
    mail = re.compile(PLAIN[0])
    words, held = [], []
    for _, text in rows:
        blank = mail.sub(lambda m: " " * len(m.group()), text)
        found = []
        for m in WORD.finditer(blank):
            core = m.group().strip(pii.PUNCTUATION)
            at = m.start() + len(m.group()) - len(m.group().lstrip(pii.PUNCTUATION))
            found += [(at, at + len(core), core.lower())] if core else []
        words.append(found)
        held.append({m.group().lower() for m in mail.finditer(text)})
        terms = {w for _, _, w in found}
        df.update(terms)
        de.update(held[-1])
        co.update((e, w) for e in held[-1] for w in terms)
    def share(e, w):
        if co[e, w] < 3 or de[e] == n:
            return 0
        return (math.log(co[e, w]) + math.log(n) - math.log(df[w]) - math.log(de[e])) / (math.log(n) - math.log(de[e]))
    return [[(a, b) for a, b, w in found if max((share(e, w) for e in es), default=0) >= 0.7 - 1e-12]
            for found, es in zip(words, held)]


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_disclosing_terms_of_whole_texts(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "FEW_TERMS", few, raising=False)
    rng = random.Random(9)
    rows = []
    for i in range(80):
        noise = lambda k: " ".join(rng.choice(["alpha", "bravo", "delta", "gamma", "house"]) for _ in range(k))
        if i % 10 == 0:
            # Far words, short names, digits, hyphens, other scripts, and the word a second time.
            rows.append((i, f"Lee, {noise(60)} \"X-15\" {noise(40)} mail:boss@corp.example é {noise(50)} (R2d2) 王芳 {noise(30)} LEE! "
                            f"-- {noise(5)} other{i}@corp.example"))
        elif i % 10 == 5:
            rows.append((i, f"{noise(30)} x-15 sales@corp.example {noise(100)} O'Neil {'common ' * (i % 4)}"))
        else:
            rows.append((i, noise(20) + (" é" if i % 2 else "")))
    want = disclosing_by_brute_force(rows)
    docs = documents(spark, rows)
    out = {r.doc_id: [(s["start"], s["end"]) for s in r.added] for r in pii.find_spans(docs).collect()}
    assert [out[i] for i, _ in rows] == want
    assert {rows[0][1][a:b] for a, b in out[0]} >= {"Lee", "LEE", "R2d2", "王芳", "mail"} and out[1] == []
    assert "LEE" not in {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[0]


def test_sanitise_masks_overlapping_spans_once(spark):
    docs = documents(spark, [(1, "call +4111111111111111 now"), (2, "x +1 (234) 567-8901 y a@b.cc z"), (3, None), (4, "é 1.2.3.4 ü")])
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert got == {1: "call +[CARD] now", 2: "x [PHONE] y [EMAIL] z", 3: None, 4: "é [IP] ü"}


def test_empty_tables(spark):
    import public_tokenizers as P
    docs = documents(spark, [])
    assert mixing.mix(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    assert pii.find_spans(docs).count() == 0 and pii.sanitise(docs).count() == 0
    assert byte_bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["n_tokens"], ["doc_id"]).count() == 0
