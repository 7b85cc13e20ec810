"""Sinks: parquet bucketed for the feature joins, CSV with fixed decimals, JSON manifest."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.profiles import fingerprint
from ebbtide.params import Params


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple = (),
                digits: int | None = None) -> None:
    """Write with overwrite semantics; CSV rounds doubles to a fixed number of decimals."""
    if fmt == "csv" and digits is not None:
        df = df.select(*[F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t == "double"
                         else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("lineSep", "\n")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_bucketed(df: DataFrame, name: str, buckets: int, key: str = "household_id") -> None:
    """Managed table bucketed by household: later feature joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def config_hash(params: Params) -> str:
    return hashlib.sha256(json.dumps(asdict(params), sort_keys=True).encode()).hexdigest()[:16]


def write_manifest(df: DataFrame, path: str, params: Params, passed: bool) -> None:
    row = fingerprint(df, config_hash(params), passed)
    row.withColumn("columns", F.array(*[F.lit(c) for c in df.columns])).write.mode(
        "overwrite").json(path)
