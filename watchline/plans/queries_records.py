"""Queries of stored documents and records: zone files, ground truth, plates, notes, files, life cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchline.functions import scoring, text
from watchline.operators import incidents, plates, records, reports, zones
from watchline.plans.base import observations, query
from watchline.plans.queries_state import CROSSED_SQL, INSIDE_SQL, inside, one_wire
from watchline.sources import definitions, ground_truth, snapshots
from watchline.sources.tables import table

S = SparkSession


@query("src10_zone_file", "SELECT 'Z' || s_suppkey AS zone_id, CASE s_suppkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'restricted' WHEN 2 THEN 'normal' ELSE 'restricted' END AS severity, s_suppkey % 5 <> 0 AS is_active, CAST(s_suppkey AS DOUBLE) AS x3, 30.0 AS debounce FROM supplier", False)
def src10(spark: S, d: str) -> DataFrame:
    """Zones of one JSON document for each supplier; every fourth names no severity, every fifth is turned off."""
    severity = F.element_at(F.array(*(F.lit(v) for v in (', "severity": " High "', ', "severity": "medium"', ', "severity": "odd"', ""))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    active = F.when(F.col("s_suppkey") % 5 == 0, ', "is_active": false').otherwise("")
    value = F.concat(F.lit('{"zones": [{"zone_id": "Z'), "s_suppkey", F.lit('", "name": "n", "polygon": [[0, 0], [5, 9], ['), "s_suppkey", F.lit(", 2.5]]"), severity, active, F.lit("}]}"))
    found = definitions.zones_of(table(spark, d, "supplier").select(value.alias("value")))
    return found.select("zone_id", "severity", "is_active", F.col("polygon")[2]["x"].alias("x3"), F.col("loitering_debounce_seconds").alias("debounce"))


@query("snk19_zone_save", "SELECT 'Z' || s_suppkey AS zone_id, CAST(s_nationkey AS DOUBLE) AS x2, CAST(s_suppkey AS DOUBLE) AS y2, CASE WHEN s_suppkey % 2 = 0 THEN 'critical' ELSE 'normal' END AS severity FROM supplier", False)
def snk19(spark: S, d: str) -> DataFrame:
    """Zones written as one document for each nation, and read again."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    polygon = F.array(point(F.lit(0), F.lit(0)), point(F.col("s_nationkey"), F.col("s_suppkey")), point(F.lit(1), F.lit(9)))
    stored = table(spark, d, "supplier").select("s_nationkey", F.concat(F.lit("Z"), "s_suppkey").alias("zone_id"), polygon.alias("polygon"), F.when(F.col("s_suppkey") % 2 == 0, "critical").otherwise("normal").alias("severity"))
    again = definitions.zones_of(definitions.documents_from(stored, "s_nationkey"))
    return again.select("zone_id", F.col("polygon")[1]["x"].alias("x2"), F.col("polygon")[1]["y"].alias("y2"), "severity")


@query("src13_pedestrian_truth", "SELECT k AS frame, event_id AS track_id, x AS x1, y AS y1, x + 50 AS x2, y + 120 AS y2, CAST(event_id % 3 AS DOUBLE) AS confidence FROM x WHERE event_id % 3 > 0 AND (event_id % 5 = 0 OR (user_id % 2 = 0 AND k >= 10))")
def src13(spark: S, d: str) -> DataFrame:
    """Lines of ground truth; every fifth has no class and no visibility."""
    full = F.when(F.col("event_id") % 5 != 0, F.concat_ws(",", F.lit(""), F.col("user_id") % 2 + 1, F.col("k") / 100)).otherwise("")
    line = F.concat(F.concat_ws(",", "k", "event_id", "x", "y", F.lit("50"), F.lit("120"), F.col("event_id") % 3), full)
    return ground_truth.pedestrians(observations(spark, d).select(line.alias("value")))


@query("src14_aerial_truth", "SELECT k AS frame, event_id AS track_id, x AS x1, y AS y1, x + 50 AS x2, y + 120 AS y2, CAST(event_id % 3 AS DOUBLE) AS confidence, user_id % 11 AS category FROM x WHERE event_id % 3 > 0 AND user_id % 11 IN (1, 2, 4, 5, 6, 9) AND event_id % 7 > 0")
def src14(spark: S, d: str) -> DataFrame:
    """Lines of aerial ground truth; every seventh is too short."""
    line = F.concat_ws(",", "k", "event_id", "x", "y", F.lit("50"), F.lit("120"), F.col("event_id") % 3, F.when(F.col("event_id") % 7 > 0, F.col("user_id") % 11), F.when(F.col("event_id") % 7 > 0, F.lit(0)))
    return ground_truth.aerial(observations(spark, d).select(line.alias("value")))


@query("src18_snapshots")
def src18(spark: S, d: str) -> DataFrame:
    return snapshots.listed(spark, d, "region*").select("name", "length")


@query("snk05_json_export", "SELECT CAST(to_json({'event_id': event_id, 'event_type': event_type, 'k': nullif(k, 7)}) AS VARCHAR) AS json FROM x")
def snk05(spark: S, d: str) -> DataFrame:
    return records.exported(observations(spark, d).withColumn("k", F.nullif("k", F.lit(7))), ["event_id", "event_type", "k"])


@query("jsn02_serialised", "SELECT event_id, CAST(to_json(MAP {'kind': event_type, 'camera': CAST(camera_id AS VARCHAR)}) AS VARCHAR) AS meta FROM x")
def jsn02(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", F.to_json(F.create_map(F.lit("kind"), "event_type", F.lit("camera"), F.col("camera_id").cast("string"))).alias("meta"))


@query("snk11_append_transitions", "SELECT event_id, user_id FROM x WHERE event_id % 3 <> 0")
def snk11(spark: S, d: str) -> DataFrame:
    """Transitions that come twice are appended once, those stored already not at all."""
    x = observations(spark, d).select("event_id", "user_id")
    return records.appended(x.where("event_id % 3 = 0"), x.unionByName(x), ["event_id"])


STATUSES = ["DETECTED", "ACTIVE", "ESCALATED", "ACKNOWLEDGED", "RESOLVED"]


@query(
    "snk18_decommission",
    f"""WITH i AS (SELECT s_suppkey AS id, s_nationkey AS c, ['DETECTED', 'ACTIVE', 'ESCALATED', 'ACKNOWLEDGED', 'RESOLVED'][s_suppkey % 5 + 1] AS status FROM supplier),
    h AS (SELECT *, c IN (5, 7) AND status IN ('DETECTED', 'ACTIVE', 'ESCALATED') AS hit FROM i)
    SELECT 'incident' AS kind, CAST(id AS VARCHAR) AS id, CASE WHEN hit THEN 'RESOLVED' ELSE status END AS state, CASE WHEN hit THEN 'Camera ' || c || ' decommissioned' END AS note FROM h
    UNION ALL SELECT 'alert', CAST(id AS VARCHAR), CASE WHEN hit THEN 'RESOLVED' ELSE 'NEW' END, NULL FROM h
    UNION ALL SELECT 'edge', n_nationkey || '-' || (n_nationkey + 1), 'kept', NULL FROM nation WHERE n_nationkey NOT IN (4, 5, 6, 7)""",
    False,
)
def snk18(spark: S, d: str) -> DataFrame:
    """Cameras 5 and 7 are taken down: their open incidents and the alerts of those are resolved, their edges removed."""
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    status = F.element_at(F.array(*(F.lit(v) for v in STATUSES)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    stored = supplier.select(F.col("s_suppkey").alias("incident_id"), F.col("s_nationkey").cast("string").alias("camera_id"), status.alias("status"))
    alerts = supplier.select(F.col("s_suppkey").alias("incident_id"), F.lit("NEW").alias("operator_status"))
    edges = nation.select(F.col("n_nationkey").cast("string").alias("from_camera"), (F.col("n_nationkey") + 1).cast("string").alias("to_camera"))
    down = spark.createDataFrame([("5",), ("7",)], "camera_id string")
    closed, settled, left = records.decommissioned(stored, alerts, edges, down)
    rows = lambda kind, df, key, state, note: df.select(F.lit(kind).alias("kind"), key.alias("id"), state.alias("state"), note.alias("note"))
    none, key = F.lit(None).cast("string"), F.col("incident_id").cast("string")
    return (
        rows("incident", closed, key, F.col("status"), F.col("resolution_notes"))
        .unionByName(rows("alert", settled, key, F.col("operator_status"), none))
        .unionByName(rows("edge", left, F.concat_ws("-", "from_camera", "to_camera"), F.lit("kept"), none))
    )


@query("snk21_annotations", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, 'op' || (k % 3) AS operator_callsign, 'note ' || event_id AS note, CASE WHEN k % 2 = 0 THEN 'CLOSED' ELSE 'INVESTIGATING' END AS disposition FROM x WHERE event_type = 'view'")
def snk21(spark: S, d: str) -> DataFrame:
    """Views stand for operators' notes on their user's incident; odd ones name no disposition."""
    k = F.col("k")
    payload = F.to_json(F.struct(
        F.when(F.col("event_type") == "view", "operator_annotation").otherwise("other").alias("subtype"), F.concat(F.lit("op"), k % 3).alias("operator_callsign"),
        F.concat(F.lit("note "), "event_id").alias("note"), F.when(k % 2 == 0, "CLOSED").alias("disposition"),
    ))
    return records.annotations(observations(spark, d).withColumn("payload", payload), "user_id", "ts", "event_id")


@query("j05_tripwire_segments", CROSSED_SQL + " SELECT event_id, crossing FROM e")
def j05(spark: S, d: str) -> DataFrame:
    """Every move between two positions of a track that crosses the wire."""
    return zones.tripwire_crossings(observations(spark, d), one_wire(spark), ["user_id"], "ts", "event_id").select("event_id", "crossing")


@query(
    "j14_plates_in_vehicles",
    "SELECT v.event_id AS vehicle_id, arg_max(p.event_id, (p.value, -p.event_id)) AS plate_id FROM x v JOIN x p ON v.k = p.k AND v.camera_id = p.camera_id WHERE v.event_id % 3 = 0 AND p.event_id % 3 <> 0 "
    "AND p.x >= v.x - 40 AND p.y >= v.y - 30 AND p.x + 40 <= v.x + 440 AND p.y + 15 <= v.y + 330 GROUP BY v.event_id",
)
def j14(spark: S, d: str) -> DataFrame:
    x = observations(spark, d)
    corners = lambda p, w, h: [F.col("x").alias(f"{p}_x1"), F.col("y").alias(f"{p}_y1"), (F.col("x") + w).alias(f"{p}_x2"), (F.col("y") + h).alias(f"{p}_y2")]
    vehicles = x.where("event_id % 3 = 0").select("k", "camera_id", F.col("event_id").alias("vehicle_id"), *corners("v", 400, 300))
    found = x.where("event_id % 3 <> 0").select("k", "camera_id", F.col("event_id").alias("plate_id"), F.col("value").alias("confidence"), *corners("p", 40, 15))
    return plates.in_vehicles(vehicles, found, ["k", "camera_id"])


READINGS = ["KA01AB1234", "KA0IAB1234", "KAO1AB1234", "MH12CD5678", "MH12CDS678", "DL4CAF7777", "KA01AB1239"]


@query(
    "agg16_plate_consensus",
    """, r AS (SELECT user_id, (event_id % 83) / 100.0 AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n,
      ['KA01AB1234', 'KA0IAB1234', 'KAO1AB1234', 'MH12CD5678', 'MH12CDS678', 'DL4CAF7777', 'KA01AB1239'][event_id % 7 + 1] AS t FROM x),
    g AS (SELECT user_id, max(c) AS best, count(*) AS hits, round(avg(c), 9) AS mean, max(n) AS oldest, arg_max(t, (c, n)) AS plate
      FROM r WHERE n <= 12 GROUP BY user_id, CASE WHEN t IN ('KA01AB1234', 'KA0IAB1234', 'KAO1AB1234') THEN 'a' WHEN t LIKE 'MH%' THEN 'b' ELSE t END),
    m AS (SELECT user_id, arg_max({'plate': plate, 'best': best, 'hits': hits}, (round(best + 0.1 * hits, 9), mean, oldest)) AS w FROM g GROUP BY user_id)
    SELECT user_id, w.plate AS plate, round(w.best, 4) AS confidence, w.hits AS hits,
      CASE WHEN w.best >= CAST(0.55 AS DOUBLE) + CAST(0.15 AS DOUBLE) OR (w.best >= 0.55 AND w.hits >= 2) THEN 'ACCEPTED' WHEN w.best >= 0.45 AND w.hits >= 2 THEN 'CONSENSUS' ELSE 'UNCERTAIN' END AS verdict FROM m""",
)
def agg16(spark: S, d: str) -> DataFrame:
    """Readings of seven texts, of which three and two are one plate read differently."""
    read = F.element_at(F.array(*(F.lit(t) for t in READINGS)), (F.col("event_id") % 7 + 1).cast("int"))
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", read.alias("text"), (F.col("event_id") % 83 / 100).alias("confidence"))
    return plates.consensus(rows, "user_id", ["ts", "event_id"])


@query("scr09_plate_verdict", "SELECT event_id, CASE WHEN k > 70 THEN 'ACCEPTED' WHEN k >= 55 AND event_id % 3 = 2 THEN 'ACCEPTED' WHEN k >= 45 AND event_id % 3 = 2 THEN 'CONSENSUS' ELSE 'UNCERTAIN' END AS verdict FROM x")
def scr09(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", plates.verdict(F.col("k") / 100, F.col("event_id") % 3).alias("verdict"))


@query("scr12_zone_names", "SELECT event_id, ['critical', 'critical', 'restricted', 'restricted', 'restricted', 'normal', 'normal', 'normal'][k % 8 + 1] AS severity, ['critical', 'normal', 'normal', 'normal', 'restricted', 'entry', 'normal', 'normal'][k % 8 + 1] AS kind FROM x")
def scr12(spark: S, d: str) -> DataFrame:
    names = F.element_at(F.array(*(F.lit(v) for v in ("Critical", " HIGH", "medium ", "Warning", "restricted", "Entry", "odd", None))), (F.col("k") % 8 + 1).cast("int"))
    return observations(spark, d).select("event_id", scoring.zone_severity(names).alias("severity"), scoring.zone_type(names).alias("kind"))


@query("scr13_coverage_grade", "SELECT user_id, CASE WHEN p >= 90 THEN 'GRADE_A_COMBAT_READY' WHEN p >= 70 THEN 'GRADE_B_DEGRADED' ELSE 'GRADE_C_VULNERABLE' END AS grade FROM (SELECT user_id, round(100.0 * count(*) FILTER (WHERE k >= 20) / count(*), 1) AS p FROM x GROUP BY user_id)")
def scr13(spark: S, d: str) -> DataFrame:
    totals = observations(spark, d).groupBy("user_id").agg(F.count_if(F.col("k") >= 20).alias("active"), F.count("*").alias("total"))
    return totals.select("user_id", scoring.coverage_grade(F.col("active"), F.col("total"))["grade"].alias("grade"))


@query("agg32_occupied_total", INSIDE_SQL + "SELECT count(*) FILTER (WHERE i) AS total, 1 AS zones FROM (SELECT user_id, arg_max(inside, (ts, event_id)) AS i FROM z GROUP BY user_id)")
def agg32(spark: S, d: str) -> DataFrame:
    return zones.occupancy(inside(spark, d), ["user_id"], "ts", "event_id").agg(F.coalesce(F.sum("occupied"), F.lit(0)).alias("total"), F.count("*").alias("zones"))


@query(
    "hsh05_verified_files",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'INVALID' WHEN event_id % 4 = 0 THEN 'MISSING' WHEN event_id % 13 = 0 THEN 'VERIFICATION_ERROR'
      WHEN event_id % 7 = 0 THEN 'INVALID' WHEN k % 50 = 0 THEN 'COMPROMISED' ELSE 'VERIFIED' END AS status FROM x""",
)
def hsh05(spark: S, d: str) -> DataFrame:
    """Evidence without paths, hashes, files, readable bytes, or with changed ones."""
    x, e = observations(spark, d), F.col("event_id")
    path = F.concat(F.lit("f"), "event_id")
    evidence = x.select("event_id", F.when(e % 10 != 0, path).alias("path"), F.when(e % 7 != 0, F.upper(F.sha2("event_type", 256))).otherwise(" ").alias("stored"))
    now = F.sha2(F.when(F.col("k") % 50 == 0, "changed").otherwise(F.col("event_type")), 256)
    files = x.where("event_id % 4 <> 0").select(path.alias("path"), F.when(e % 13 != 0, now).alias("actual"))
    return records.verified(evidence, files).select("event_id", "status")


@query(
    "str10_life_cycle",
    """, a AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'RESOLVED' WHEN k % 19 = 0 THEN 'ACKNOWLEDGED' END AS action FROM x),
    g AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 21600 AND lag(action) OVER w IS NULL THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incident FROM g)
    SELECT user_id, incident, count(*) AS n_events, max(value) AS peak_threat, arg_max(value, (ts, event_id)) AS current_threat,
      coalesce(max(action), CASE WHEN max(value) >= 70 THEN 'ESCALATED' WHEN count(*) > 1 THEN 'ACTIVE' ELSE 'DETECTED' END) AS status FROM i GROUP BY user_id, incident""",
)
def str10(spark: S, d: str) -> DataFrame:
    action = F.when(F.col("k") % 17 == 0, "RESOLVED").when(F.col("k") % 19 == 0, "ACKNOWLEDGED")
    rows = incidents.life_cycle(observations(spark, d).withColumn("action", action), ["user_id"], "ts", "event_id", "value", 21600.0, "action")
    return rows.select("user_id", "incident", "n_events", "peak_threat", "current_threat", "status")


@query("str17_transitions", "SELECT f AS from_camera, c AS camera, count(*) AS n FROM (SELECT k % 5 AS c, lag(k % 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM x) WHERE f <> c GROUP BY f, c")
def str17(spark: S, d: str) -> DataFrame:
    """How often entities went from one camera to another."""
    moves = reports.journeys(observations(spark, d).withColumn("camera", F.col("k") % 5), "user_id", "camera", "ts", "event_id")
    return moves.where("from_camera IS NOT NULL").groupBy("from_camera", "camera").agg(F.count("*").alias("n"))


@query("strg11_display_ids", "SELECT event_id, 'GLOBAL-PERSON-' || printf('%03d', user_id) AS display_id FROM x")
def strg11(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.entity_id(F.concat(F.lit("person-"), "user_id")).alias("display_id"))


@query("set01_sections", "SELECT 1 AS section, event_id AS id, event_type AS label FROM x UNION ALL SELECT 2, s_suppkey, 'entity' FROM supplier UNION ALL SELECT 3, n_nationkey, n_name FROM nation")
def set01(spark: S, d: str) -> DataFrame:
    """Items of three kinds, each with the number of its section."""
    part = lambda n, name, key, label: table(spark, d, name).select(F.lit(n).alias("section"), F.col(key).cast("long").alias("id"), label.alias("label"))
    return part(1, "events", "event_id", F.col("event_type")).unionByName(part(2, "supplier", "s_suppkey", F.lit("entity"))).unionByName(part(3, "nation", "n_nationkey", F.col("n_name")))
