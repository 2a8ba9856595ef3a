"""Stored records: operators' notes, decommissioned cameras, verified files, appended rows, JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN = ["DETECTED", "ACTIVE", "ESCALATED"]


def appended(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to append: those whose keys aren't stored, of repeated keys one."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def annotations(timeline: DataFrame, incident: str, ts: str, seq: str, payload: str = "payload") -> DataFrame:
    """Operators' notes of each incident in order of time, read from the events' JSON payload; others are left out."""
    note = F.from_json(payload, "subtype string, annotation_id string, operator_callsign string, note string, disposition string")
    rows = timeline.withColumn("_p", note).where(F.col("_p.subtype") == "operator_annotation")
    place = F.row_number().over(Window.partitionBy(incident).orderBy(ts, seq)).cast("long")
    return rows.select(incident, place.alias("place"), "_p.operator_callsign", "_p.note", F.coalesce("_p.disposition", F.lit("INVESTIGATING")).alias("disposition"))


def decommissioned(incidents: DataFrame, alerts: DataFrame, edges: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Incidents, alerts and edges once ``cameras`` (camera_id, distinct) are taken down.

    A camera's open incidents are resolved with a note, all alerts of those incidents too, and its edges go, both ways.
    """
    down = cameras.select("camera_id", F.lit(True).alias("_down"))
    marked = incidents.join(down, "camera_id", "left").withColumn("_hit", F.coalesce(F.col("_down") & F.col("status").isin(OPEN), F.lit(False)))
    note = F.when(F.col("_hit"), F.concat(F.lit("Camera "), F.col("camera_id"), F.lit(" decommissioned")))
    closed = marked.withColumn("resolution_notes", note).withColumn("status", F.when(F.col("_hit"), "RESOLVED").otherwise(F.col("status")))
    hit = marked.where("_hit").select("incident_id", F.lit(True).alias("_hit"))
    settled = alerts.join(hit, "incident_id", "left").withColumn("operator_status", F.when(F.col("_hit"), "RESOLVED").otherwise(F.col("operator_status"))).drop("_hit")
    end = lambda name: cameras.select(F.col("camera_id").alias(name))
    left = edges.join(end("from_camera"), "from_camera", "left_anti").join(end("to_camera"), "to_camera", "left_anti")
    return closed.drop("_down", "_hit"), settled, left


def verified(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence (path, stored) against files (path, actual) with its ``status``.

    Without a path it is INVALID, without a file MISSING, with a null hash of the file's bytes VERIFICATION_ERROR,
    without a stored hash INVALID, else VERIFIED or COMPROMISED.
    """
    rows = evidence.join(files.withColumn("_there", F.lit(True)), "path", "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    status = (
        F.when(blank("path"), "INVALID").when(F.col("_there").isNull(), "MISSING").when(F.col("actual").isNull(), "VERIFICATION_ERROR")
        .when(blank("stored"), "INVALID").when(F.lower("stored") == F.lower("actual"), "VERIFIED").otherwise("COMPROMISED")
    )
    return rows.withColumn("status", status).drop("_there")


def exported(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as one JSON object of the columns named, in that order; nulls are kept."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
