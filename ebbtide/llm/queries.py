"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import (
    ann, byte_bpe, exact_dedup, hard_negatives, html_extract, jaccard_join, mixing, pii, quality, toxicity, url_filters,
    warc, whitening)
from ebbtide.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


#: The rules of the URL query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "template", "purity")


def _judged(scores: DataFrame, remainder: int, modulus: int) -> DataFrame:
    return scores.select("doc_id", quality.held_out(remainder, modulus).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def good_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted good texts: the labelled ones that are not held out."""
    return table(spark, sf_dir, "labels").filter("quality = 1").filter(~quality.held_out(0, 5))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(quality.scored(table(spark, sf_dir, "documents"), good_examples(spark, sf_dir)), 0, 5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out(2, 4))
    return _judged(toxicity.passages(table(spark, sf_dir, "documents"), labels), 2, 4)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    # A lambda of two parameters would be given the position as its second one.
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [counted(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                        pii.listed(F.concat("base", "added")).alias("spans"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return byte_bpe.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, ["n_tokens", "ids_sha256", "decoded_sha256"], ["doc_id"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    pair = F.explode(F.arrays_zip("whitened", "explained", F.sequence(F.lit(1), F.size("whitened")).alias("component")))
    return rows.filter(F.size("whitened") > 0).select("vec_id", "n", "deviation", "identity_error", pair.alias("c")).select(
        "vec_id", F.col("c.component").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_url_filters, op3_quality, op4_toxicity, op5_exact_dedup, op6_warc, op7_nearest,
    op8_mixing, op9_pii, op10_byte_bpe, op11_hard_negatives, op12_whitening,
    op13_html_extraction)}
