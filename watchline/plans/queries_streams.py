"""Queries that run a stream over a whole table to its end, and appends by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchline.functions import scoring
from watchline.plans.base import query
from watchline.plans.queries_events import ASOF_SQL
from watchline.sources.staging import shared_folder
from watchline.sources.tables import table
from watchline.streaming import stateful

S = SparkSession


def own_folder(spark: S, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def streamed(spark: S, d: str, name: str) -> DataFrame:
    """The table as a stream; as a pattern its path may name one file or a folder of them."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}[.]parquet")


@query("str14_stream_correlation", ASOF_SQL)
def str14(spark: S, d: str) -> DataFrame:
    """Exits and entries as one stream, folded by class and hour; of the pairs each entry's latest exit."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = lambda kind: streamed(spark, d, "events").where(F.col("event_type") == kind).select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 8).alias("camera_id"), (k % 10).alias("object_class"))
    pairs = stateful.run_to_end(stateful.correlated(rows("error"), rows("signup"), 3600), own_folder(spark, "str14"))
    found = stateful.latest_exits(pairs)
    none = F.lit(None).cast("double")
    confidence = F.round(scoring.correlation_confidence(F.col("delta_seconds"), none, none, 3600.0), 3)
    return found.select("entry_id", "exit_id", "from_camera", "to_camera", F.round("delta_seconds", 3).alias("delta_seconds"), confidence.alias("confidence"))


@query("snk01_sequences", "SELECT event_id, row_number() OVER (ORDER BY event_id % 3, ts, event_id) AS seq_id FROM x")
def snk01(spark: S, d: str) -> DataFrame:
    """Three batches stored one after the other, the second one twice, and the third with rows that are stored already."""
    rows, folder = table(spark, d, "events"), own_folder(spark, "snk01")
    append = stateful.persisted_then_published(folder, lambda stored, number: None, order=["ts", "event_id"])
    batch = lambda k: rows.where(F.col("event_id") % 3 == k)
    for number, part in [(0, batch(0)), (1, batch(1)), (1, batch(1)), (2, batch(2).union(batch(0)))]:
        append(part, number)
    return spark.read.parquet(folder).select("event_id", "seq_id")


@query("snk02_persisted_first", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq_id, true AS stored FROM x")
def snk02(spark: S, d: str) -> DataFrame:
    """What is published of a stream, each row with whether it was in the store by then."""
    folder = own_folder(spark, "snk02")

    def publish(rows: DataFrame, number: int) -> None:
        kept = spark.read.parquet(f"{folder}/store").select("event_id", F.lit(True).alias("stored"))
        rows.select("event_id", "seq_id").join(kept, "event_id", "left").fillna(False, ["stored"]).write.mode("overwrite").parquet(f"{folder}/published/batch={number}")

    append = stateful.persisted_then_published(f"{folder}/store", publish, order=["ts", "event_id"])
    streamed(spark, d, "events").writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/published").select("event_id", "seq_id", "stored")
