"""Reading the Parquet tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, which may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
