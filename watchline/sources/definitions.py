"""Zones and tripwires kept as one JSON document: ``{"zones": [...], "boundaries": [...]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchline.functions import scoring

#: Rules of the built-in demonstration, which are never active once stored.
DEMO_RULES = ["BORDER_RESTRICTED_STRIP_01", "VIRTUAL_PERIMETER_FENCE_01"]
ZONE = "zone_id string, name string, polygon array<array<double>>, severity string, is_active boolean, loitering_threshold_seconds double, loitering_debounce_seconds double"
BOUNDARY = "boundary_id string, name string, pt1 array<double>, pt2 array<double>, severity string, direction string, debounce_seconds double, is_active boolean"
DOCUMENT = f"zones array<struct<{ZONE.replace(' ', ':').replace(',:', ',')}>>, boundaries array<struct<{BOUNDARY.replace(' ', ':').replace(',:', ',')}>>"


def _active(name: str) -> Column:
    return F.coalesce(F.col("is_active"), F.lit(True)) & ~F.col(name).isin(DEMO_RULES)


def zones_of(documents: DataFrame, text: str = "value") -> DataFrame:
    """Zones of JSON documents, one in a row, with the defaults of what they leave out; broken JSON has none."""
    z = documents.select(F.explode(F.from_json(text, DOCUMENT)["zones"]).alias("z")).select("z.*").where("zone_id IS NOT NULL")
    points = F.transform("polygon", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return z.select(
        "zone_id", "name", points.alias("polygon"), scoring.zone_severity(F.coalesce("severity", F.lit("restricted"))).alias("severity"), _active("zone_id").alias("is_active"),
        F.col("loitering_threshold_seconds"), F.coalesce("loitering_debounce_seconds", F.lit(30.0)).alias("loitering_debounce_seconds"),
    )


def boundaries_of(documents: DataFrame, text: str = "value") -> DataFrame:
    """Tripwires of JSON documents, one in a row, with the defaults of what they leave out."""
    b = documents.select(F.explode(F.from_json(text, DOCUMENT)["boundaries"]).alias("b")).select("b.*").where("boundary_id IS NOT NULL")
    ends = [F.col(p)[i].alias(name) for p, i, name in (("pt1", 0, "ax"), ("pt1", 1, "ay"), ("pt2", 0, "bx"), ("pt2", 1, "by"))]
    return b.select(
        "boundary_id", "name", *ends, scoring.zone_severity(F.coalesce("severity", F.lit("critical"))).alias("severity"), F.coalesce("direction", F.lit("BIDIRECTIONAL")).alias("direction"),
        F.coalesce("debounce_seconds", F.lit(3.0)).alias("debounce_seconds"), _active("boundary_id").alias("is_active"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as rows of ``value``."""
    return spark.read.text(path, wholetext=True)


def documents_from(zones: DataFrame, site: str, most: int = 1000) -> DataFrame:
    """JSON documents of each site, its zones by id, up to ``most`` in one; the counterpart of ``zones_of``."""
    points = F.transform("polygon", lambda p: F.array(p["x"], p["y"]))
    names = [c for c in zones.columns if c not in (site, "polygon")]
    listed = F.array_sort(F.collect_list(F.struct("zone_id", points.alias("polygon"), *(n for n in names if n != "zone_id"))))
    # A site's zones are numbered in one sort, which spills; what is gathered is bounded.
    part = F.floor((F.row_number().over(Window.partitionBy(site).orderBy("zone_id")) - 1) / most)
    return zones.withColumn("_part", part).groupBy(site, "_part").agg(F.to_json(F.struct(listed.alias("zones"))).alias("value")).drop("_part")


PRESET = "vendor string, model string, protocol string, default_port int, uri_template string, description string, recommended_transport string"
PRESETS = f"presets array<struct<{PRESET.replace(' ', ':').replace(',:', ',')}>>"


def presets_of(documents: DataFrame, text: str = "value") -> DataFrame:
    """Camera presets of JSON documents ``{"presets": [...]}``, one in a row; without a vendor or a template it is none.

    What a preset leaves out: protocol rtsp, port 554 and transport tcp.
    """
    found = documents.select(F.explode(F.from_json(text, PRESETS)["presets"]).alias("p")).select("p.*").where("vendor IS NOT NULL AND uri_template IS NOT NULL")
    return found.fillna({"protocol": "rtsp", "default_port": 554, "recommended_transport": "tcp"})


def stream_uri(template: Column, values: dict[str, Column]) -> Column:
    """A preset's template with ``{name}`` replaced by each value; a null value leaves its name in place."""
    for name, value in values.items():
        template = F.coalesce(F.replace(template, F.lit(f"{{{name}}}"), value.cast("string")), template)
    return template
