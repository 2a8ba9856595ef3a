"""Incidents: sessions of threatening events of one target, with one alert each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchline.functions import scoring
from watchline.operators.folds import seconds


def incident_key(entity: Column, camera: Column, track: Column, zone: Column) -> Column:
    """What an event is matched by: its entity, else its camera and track, else its zone and camera."""
    by_track = F.concat(F.lit("T:"), camera, F.lit(":"), track)
    by_zone = F.concat(F.lit("Z:"), zone, F.lit(":"), camera)
    return F.coalesce(F.concat(F.lit("E:"), entity), by_track, by_zone)


def numbered_incidents(events: DataFrame, keys: list[str], ts: str, seq: str, gap: float, closes: Column | None = None) -> DataFrame:
    """Events with the number of their incident by key: a new one begins after more than ``gap`` seconds.

    A row for which ``closes`` holds ends the incident that it belongs to; the next one starts anew.
    """
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    waited = seconds(F.col(ts)) - F.lag(seconds(F.col(ts))).over(w)
    new = F.lag(F.lit(1)).over(w).isNull() | (waited > gap)
    if closes is not None:
        new = new | F.coalesce(F.lag(closes).over(w), F.lit(False))
    return events.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("incident", F.sum("_new").over(w)).drop("_new")


def incidents(numbered: DataFrame, keys: list[str], ts: str, seq: str, score: str) -> DataFrame:
    """One row for each incident: span, peak and last score, severity, status, its alert, and what that spared."""
    order = F.struct(ts, seq)
    qualifies = F.col(score) >= 30
    rows = numbered.groupBy(*keys, "incident").agg(
        F.count("*").alias("n_events"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.max(score).alias("peak_threat"),
        F.max_by(score, order).alias("current_threat"),
        F.min_by(score, order).alias("first_threat"),
        F.count_if(qualifies).alias("qualifying"),
        F.min_by(score, F.when(qualifies, order)).alias("alert_score"),
    )
    escalated = F.col("peak_threat") >= 70
    alert = F.when(F.col("qualifying") > 0, scoring.band(F.col("alert_score"), scoring.ALERT_SEVERITIES, "MEDIUM"))
    return (
        rows.withColumn("severity", scoring.incident_severity(F.col("peak_threat")))
        .withColumn("status", F.when(escalated, "ESCALATED").when(F.col("n_events") > 1, "ACTIVE").otherwise("DETECTED"))
        .withColumn("alert_severity", alert)
        .withColumn("suppressed", F.greatest(F.col("n_events") - F.when(F.col("qualifying") > 0, 1).otherwise(0), F.lit(0)))
        .drop("first_threat", "alert_score")
    )


def suppression(rows: DataFrame) -> DataFrame:
    """Totals over incidents and the share of events that raised no alert of their own; 100 without events."""
    totals = rows.agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"), F.count("*").alias("n_incidents"), F.count("alert_severity").alias("n_alerts"))
    rate = F.when(F.col("n_events") > 0, F.round(100.0 * (F.col("n_events") - F.col("n_alerts")) / F.col("n_events"), 1)).otherwise(100.0)
    return totals.withColumn("suppression_rate", rate)


def evidence_accepted(incident_entity: Column, evidence_entity: Column) -> Column:
    """Evidence of another entity than the incident's is rejected; a missing one on either side passes."""
    return F.coalesce(incident_entity == evidence_entity, F.lit(True))


def life_cycle(events: DataFrame, keys: list[str], ts: str, seq: str, score: str, gap: float, action: str) -> DataFrame:
    """Incidents whose events may carry an operator's ``action`` (ACKNOWLEDGED, RESOLVED; null else), which ends them.

    The next event of the key begins a new incident; an incident so ended has the action as its status.
    """
    numbered = numbered_incidents(events, keys, ts, seq, gap, F.col(action).isNotNull())
    ended = numbered.where(F.col(action).isNotNull()).select(*keys, "incident", F.col(action).alias("_action"))
    rows = incidents(numbered, keys, ts, seq, score).join(ended, [*keys, "incident"], "left")
    return rows.withColumn("status", F.coalesce("_action", "status")).drop("_action")
