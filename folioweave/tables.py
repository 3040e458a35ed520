"""Reading the pipeline's tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_key(c):
    """Trimmed lower-case form under which types and sources are compared."""
    return F.lower(F.trim(c))
