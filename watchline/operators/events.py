"""Event-store operators: scans, filters, pages, rollups and payload projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchline.sources.staging import staged

#: Payload fields by event type, beyond the base fields.
BASE_FIELDS = "event_id string, event_type string, timestamp string, camera_id string, track_id string, global_person_id string, incident_id string, confidence double, source string"
PAYLOADS = {
    "DETECTION": "object_class string, bounding_box array<double>, frame_number int",
    "TRACKING": "lifecycle string, position array<double>, velocity array<double>, object_class string, bounding_box array<double>, frame_number int, speed double, direction double, cardinal_heading string, dwell double, movement_state string, threat_score double",
    "ZONE": "zone_id string, zone_name string, zone_severity string, transition string, dwell_duration_seconds double, crossing_direction string, narrative string, threat_score double, threat_reasons array<string>",
    "RISK": "risk_level string, threat_score double, reasons array<string>",
    "EVIDENCE": "frame_path string, frame_number int, trigger_reason string, frame_type string",
    "ALERT": "alert_id string, severity string, message string, narrative string, acknowledged boolean, threat_score double, threat_level string, threat_reasons array<string>, modality string",
    "INCIDENT": "lifecycle string, event_ids array<string>",
    "SYSTEM": "subtype string, details string",
    "HANDOFF": "from_camera string, to_camera string, association_score double, association_status string",
    "ANPR": "plate_number string, vehicle_class string, detection_confidence double, is_verified_format boolean",
    "FACE": "face_detected boolean, face_bounding_box array<double>, identity_claim string",
    "CORRELATION": "source_camera string, target_camera string, source_zone string, target_zone string, time_delta_seconds double, correlation_confidence double, correlation_label string, narrative string",
}


def payload_schema(event_type: str) -> T.StructType:
    return T._parse_datatype_string(f"{BASE_FIELDS}, {PAYLOADS[event_type]}")


def typed(events: DataFrame, event_type: str, payload: str = "metadata") -> DataFrame:
    """Events of one type with their payload parsed as ``p``; a broken payload has null fields."""
    return events.where(F.col("event_type") == event_type).withColumn("p", F.from_json(payload, payload_schema(event_type)))


def matching(**equal: object) -> Column:
    """The conjunction of equalities with those arguments that are given."""
    return reduce(lambda a, b: a & b, (F.col(c) == v for c, v in equal.items() if v is not None), F.lit(True))


def all_of(conditions: list[Column]) -> Column:
    """The conjunction of conditions; true if there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    """The disjunction of conditions; false if there are none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def get_events(events: DataFrame, ts: str, seq: str, since: str | None = None, after_seq: int | None = None, newest_first: bool = False, limit: int = 100, **equal: object) -> DataFrame:
    """The oldest (or newest) ``limit`` events by time and sequence, after optional filters."""
    rows = events.where(matching(**equal))
    if since is not None:
        rows = rows.where(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    if after_seq is not None:
        rows = rows.where(F.col(seq) > after_seq)
    order = [F.desc(ts), F.desc(seq)] if newest_first else [F.asc(ts), F.asc(seq)]
    return rows.orderBy(*order).limit(limit)


def newest_in_order(events: DataFrame, ts: str, seq: str, limit: int, **equal: object) -> DataFrame:
    """The newest ``limit`` events, oldest first."""
    return get_events(events, ts, seq, newest_first=True, limit=limit, **equal).orderBy(ts, seq)


def limited_then_filtered(events: DataFrame, ts: str, seq: str, limit: int, column: str, value: str) -> DataFrame:
    """The newest ``limit`` events first, and only then those whose column has a value in any case."""
    return get_events(events, ts, seq, newest_first=True, limit=limit).where(F.upper(column) == value.upper())


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def truthy(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def last_by(rows: DataFrame, keys: list[str], value: str, ts: str, seq: str) -> DataFrame:
    """The value of each group's last row by time and sequence."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(ts, seq)).alias(f"last_{value}"))


def append_new(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The batch's rows whose key isn't stored yet, one for each key."""
    return batch.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def acknowledged(alerts: DataFrame, acks: DataFrame, key: str, at: str) -> DataFrame:
    """Alerts with their latest acknowledgement, if there is one."""
    latest = acks.groupBy(key).agg(F.max(at).alias("acknowledged_at"))
    return alerts.join(latest, key, "left").withColumn("is_acknowledged", F.col("acknowledged_at").isNotNull())


def incident_rollup(events: DataFrame, keys: list[str], ts: str, limit: int) -> DataFrame:
    """Count, first and last time of each group, the latest groups first."""
    rows = events.groupBy(*keys).agg(F.count("*").alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return rows.orderBy(F.desc("last_ts"), *keys).limit(limit)


def upserted(stored: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of both, the last one by ``order`` for each key; the batch wins ties."""
    both = stored.withColumn("_turn", F.lit(0)).unionByName(batch.withColumn("_turn", F.lit(1)))
    names = [c for c in stored.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order, "_turn")).alias("row"))
    return last.select(key, "row.*")


def merged_metadata(old: Column, new: Column) -> Column:
    """Two maps as one; the new one's values win."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.coalesce(F.map_concat(kept, new), old, new)


def sequenced(rows: DataFrame, order: list[str], used: int = 0) -> DataFrame:
    """Rows with ``seq_id``, from ``used`` + 1 on without a gap, in ``order``, which has to be unique.

    Rows are sorted by range, and numbered within each partition after those before it; only the partitions' counts meet
    in one task.
    """
    # Staged, as the counts and the numbers have to see the same partitions.
    dealt = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    numbered = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row for each partition
    return numbered.withColumn("seq_id", F.lit(used + 1) + F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


#: The payload fields of an alert, and the defaults of its message, severity and modality.
ALERT_FIELDS = (
    "message string, severity string, is_acknowledged boolean, threat_score double, threat_level string, threat_reasons array<string>, causal_chain array<string>, "
    "evidence_snapshot_uri string, face_snapshot_uri string, anpr_snapshot_uri string, best_frame_number int, modality string, timeline_offset_sec double, heading string, "
    "speed_description string, target_bbox array<double>, plate_number string, plate_confidence double, plate_uncertain boolean, face_confidence double"
)
ALERT_MESSAGE, ALERT_SEVERITY, ALERT_MODALITY = "Security Perimeter Violation", "CRITICAL", "STANDARD"


def alert_items(alerts: DataFrame, payload: str = "payload") -> DataFrame:
    """Alerts with their payload's fields beside their own columns, which come first where they are set.

    ``message``, ``severity`` and ``is_acknowledged`` may be columns already; empty ones count as not set. A severity is in
    capitals; a missing or broken payload leaves the defaults.
    """
    # The parsed payload is a column of its own: Spark would parse it again for each field that it is asked for.
    alerts = alerts.withColumn("_p", F.from_json(payload, ALERT_FIELDS))
    p = F.col("_p")
    own = lambda name: truthy(F.col(name), p[name]) if name in alerts.columns else truthy(p[name])
    acknowledged = F.coalesce(F.col("is_acknowledged"), F.lit(False)) if "is_acknowledged" in alerts.columns else F.lit(False)
    fields = {f.name: p[f.name] for f in T._parse_datatype_string(ALERT_FIELDS)}
    fields |= {
        "message": F.coalesce(own("message"), F.lit(ALERT_MESSAGE)),
        "severity": F.upper(F.coalesce(own("severity"), F.lit(ALERT_SEVERITY))),
        "is_acknowledged": acknowledged | F.coalesce(p["is_acknowledged"], F.lit(False)),
        "modality": F.coalesce(p["modality"], F.lit(ALERT_MODALITY)),
        "plate_uncertain": F.coalesce(p["plate_uncertain"], F.lit(False)),
    }
    kept = [c for c in alerts.columns if c not in fields and c != "_p"]
    return alerts.select(*kept, *(c.alias(name) for name, c in fields.items()))
