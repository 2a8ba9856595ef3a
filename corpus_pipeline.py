"""A corpus from raw documents to token ids: toxic documents go, one document of each near-duplicate group
stays, documents with benchmark passages go, secrets are masked, and the texts are encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from watchline.llm import bpe, decontaminate, near_dups, secrets, toxicity
from watchline.llm.common import shared_folder
from watchline.llm.queries import VOCABULARY
from watchline.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.without_near_dups(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_table(docs, VOCABULARY, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dups", drop_near_dups),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The stages' models and searches can't be put in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again.

    Rows with a null or empty text come through all stages with no tokens, rows without an id as well; repeated rows stay
    or go together. An empty table gives no rows.
    A stage's folder goes as soon as the next one is written; the last one stays, as the result is read from it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            removed(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
