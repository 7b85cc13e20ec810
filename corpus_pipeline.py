"""Corpus pipeline: quality, exact copies, near copies, source mix, tokens.

Each stage reads the documents that its predecessor wrote and works on all of them.  The first four
return documents; the last returns token counts and digests of every row of the mix, which holds a
document once for each epoch that takes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbtide.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality
from ebbtide.llm.common import table
from ebbtide.llm.queries import good_examples
from ebbtide.operators.lineage import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, good_examples(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_component(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                  ["n_tokens", "ids_sha256", "decoded_sha256"], ["doc_id", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies),
    ("source_mixing", source_mix), ("byte_bpe", token_ids)]

#: The classifier's fit and the hash keys of the mix are not SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs
