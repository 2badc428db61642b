"""Readers of the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """Digest of the values of ``columns``: equal for equal rows only, nulls told from empty texts."""
    return F.md5(F.concat(*(F.coalesce(F.concat(F.lit("v"), F.md5(F.col(c).cast("string"))), F.lit("n")) for c in columns)))
