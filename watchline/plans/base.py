"""The registry of queries over the event tables, and the rows that they share.

The test tables have no cameras or positions; those are derived from ids, the same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchline.plans.registry import Registry
from watchline.sources.tables import table

REGISTRY = Registry()

#: SQL of the rows that ``observations`` gives, as the common table x.
X = """WITH x AS (
  SELECT event_id, ts, user_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    user_id % 8 AS camera_id, CAST((event_id * 37) % 1280 AS DOUBLE) AS x, CAST((event_id * 91) % 720 AS DOUBLE) AS y,
    CAST((event_id * 13) % 21 - 10 AS DOUBLE) AS vx, CAST((event_id * 7) % 21 - 10 AS DOUBLE) AS vy,
    epoch_us(ts) / 1000000.0 AS s
  FROM events)
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a payload number, a camera, a position, a velocity, and the time in seconds."""
    e = F.col("event_id")
    number = lambda c: c.cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.col("user_id") % 8).alias("camera_id"),
        number(e * 37 % 1280).alias("x"), number(e * 91 % 720).alias("y"),
        number(e * 13 % 21 - 10).alias("vx"), number(e * 7 % 21 - 10).alias("vy"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"),
    )


def query(name: str, sql: str | None = None, with_x: bool = True):
    """Register a query; its SQL may use the common table x."""
    return REGISTRY.query(name, (X + sql if with_x else sql) if sql is not None else None)
