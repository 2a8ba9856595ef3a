"""Listing of stored files by name, without reading their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Name, length and time of the files of a folder whose names match ``pattern``, in folders below it too."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", "modificationTime")


def digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path and SHA-256 of each file's bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("actual"))
