"""Numbers of rows that hold in every job."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.lineage import stored


def place_of(df: DataFrame) -> Column:
    """``__place`` of the rows; without it a number that holds for this one scan only."""
    return F.col("__place") if "__place" in df.columns else F.monotonically_increasing_id()


def _is_parquet_scan(df: DataFrame) -> bool:
    if "_metadata" in df.columns or df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        return bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def placed(df: DataFrame) -> DataFrame:
    """The rows with a ``__place`` that stays the same in every job.

    Spark cuts a table anew for each job, by the cores registered then, so a number given in one scan
    may belong to another row in the next.  Rows of Parquet files are known by file and row in it;
    other tables are written down with their places.
    """
    if "__place" in df.columns:
        return df
    if not _is_parquet_scan(df):
        return stored(df.withColumn("__place", place_of(df)))
    names = sorted(r[0] for r in df.select(F.col("_metadata.file_path").alias("name")).distinct().collect())
    files = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "__file string, __number long")
    return (df.select("*", F.col("_metadata.file_path").alias("__in"), F.col("_metadata.row_index").alias("__index"))
            .join(F.broadcast(files), F.col("__in") == F.col("__file"))  # one row for each file
            .withColumn("__place", F.shiftleft("__number", 40) + F.col("__index"))
            .drop("__in", "__index", "__file", "__number"))
