"""Ground-truth boxes of tracking benchmarks, from lines of comma-separated numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of aerial footage that count (people, cars, vans, trucks, buses).
AERIAL_CLASSES = [1, 2, 4, 5, 6, 9]


def _boxes(lines: DataFrame, line: str, least: int) -> DataFrame:
    parts = F.split(F.trim(line), ",")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= least)
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    x, y = number(2), number(3)
    return rows.select(number(0).cast("long").alias("frame"), number(1).cast("long").alias("track_id"), x.alias("x1"), y.alias("y1"), (x + number(4)).alias("x2"), (y + number(5)).alias("y2"), number(6).alias("confidence"), "p")


def _field(i: int, otherwise: float) -> Column:
    return F.coalesce(F.get("p", F.lit(i)).try_cast("double"), F.lit(otherwise))


def pedestrians(lines: DataFrame, line: str = "value") -> DataFrame:
    """Boxes of class 1 that count and are visible by a tenth at least; shorter lines have class 1, wholly visible."""
    seen = _boxes(lines, line, 7).where((_field(7, 1.0) == 1) & (F.col("confidence") > 0) & (_field(8, 1.0) >= 0.1))
    return seen.drop("p")


def aerial(lines: DataFrame, line: str = "value") -> DataFrame:
    """Boxes of the classes that count, with their class."""
    rows = _boxes(lines, line, 8).withColumn("category", _field(7, 0.0).cast("long"))
    return rows.where((F.col("confidence") > 0) & F.col("category").isin(AERIAL_CLASSES)).drop("p")
