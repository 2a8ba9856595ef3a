"""Queries of stateful operators: zones, debounce, incidents, journeys, and greedy ones within frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchline.functions import geo
from watchline.operators import folds, frames, incidents, reports, zones
from watchline.plans.base import X, observations, query
from watchline.plans.queries_functions import SQUARE, WIRE, crossing_sql, inside_sql
from watchline.sources.tables import table

S = SparkSession
INSIDE_SQL = f", z AS (SELECT *, {inside_sql(SQUARE)} AS inside FROM x)\n"


def inside(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", "ts", "user_id", "x", "y", F.lit("square").alias("zone_id"), geo.zone_contains(F.col("x"), F.col("y"), geo.polygon(SQUARE)).alias("inside"))


@query(
    "str01_zone_transitions",
    INSIDE_SQL
    + """, t AS (SELECT *, coalesce(lag(inside) OVER w, false) AS before FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    e AS (SELECT *, last_value(CASE WHEN inside AND NOT before THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS entry FROM t)
    SELECT event_id, CASE WHEN inside THEN 'entered' ELSE 'exited' END AS transition, round(CASE WHEN inside THEN 0.0 ELSE s - entry END, 3) AS dwell FROM e WHERE inside <> before""",
)
def str01(spark: S, d: str) -> DataFrame:
    return zones.transitions(inside(spark, d), ["user_id"], "ts", "event_id").select("event_id", "transition", F.round("dwell_seconds", 3).alias("dwell"))


def greedy_sql(rows: str, wait: float, bypass: str = "false", final: str = "SELECT event_id FROM g WHERE emitted") -> str:
    """SQL of the greedy fold: a row is emitted once ``wait`` seconds have passed since the last emitted one, or by ``bypass``."""
    due = f"({bypass} OR n.s - g.last >= {wait})"
    return f""", r AS ({rows}), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, event_id) AS i FROM r),
    g AS (SELECT key, i, event_id, s AS last, true AS emitted FROM n WHERE i = 1
      UNION ALL SELECT n.key, n.i, n.event_id, CASE WHEN {due} THEN n.s ELSE g.last END, {due}
      FROM g JOIN n ON n.key = g.key AND n.i = g.i + 1)
    {final}"""


def recursive(sql: str) -> str:
    return (X + sql).replace("WITH x AS", "WITH RECURSIVE x AS", 1)


VISIT_SQL = (
    INSIDE_SQL
    + """, f AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER w, false) THEN 1 ELSE 0 END AS new FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit FROM f),
    v AS (SELECT user_id, visit, s, event_id, s - min(s) OVER (PARTITION BY user_id, visit) AS dwell FROM c WHERE inside)"""
)


def loitering_sql(threshold: float, wait: float, columns: str) -> str:
    rows = f"SELECT user_id * 1000000 + visit AS key, s, event_id FROM v WHERE dwell >= {threshold}"
    return recursive(VISIT_SQL + greedy_sql(rows, wait, final=f"SELECT {columns} FROM g JOIN v ON v.event_id = g.event_id WHERE emitted"))


@query("str03_loitering", loitering_sql(3600.0, 7200.0, "g.event_id, v.visit, round(v.dwell, 3) AS dwell"), False)
def str03(spark: S, d: str) -> DataFrame:
    return zones.loitering(inside(spark, d), ["user_id"], "ts", "event_id", 3600.0, 7200.0).select("event_id", "visit", F.round("dwell_seconds", 3).alias("dwell"))


MOVE_SQL = """, l AS (SELECT event_id, user_id, s, lag(x) OVER w AS px, lag(y) OVER w AS py, x AS qx, y AS qy FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT event_id, user_id, s, px AS x, py AS y, qx AS x2, qy AS y2 FROM l WHERE px IS NOT NULL),
    """
CROSSED_SQL = MOVE_SQL + "e AS (" + crossing_sql("event_id, user_id, s") + ")"


@query("str05_tripwire", recursive(CROSSED_SQL + greedy_sql("SELECT user_id AS key, s, event_id FROM e", 3.0, final="SELECT g.event_id, e.crossing FROM g JOIN e ON e.event_id = g.event_id WHERE emitted")), False)
def str05(spark: S, d: str) -> DataFrame:
    wires = one_wire(spark)
    found = zones.tripwire_crossings(observations(spark, d), wires, ["user_id"], "ts", "event_id")
    return folds.emit_with_cooldown(found, ["user_id", "boundary_id"], "ts", "event_id", 3.0).select("event_id", "crossing")


def one_wire(spark: S) -> DataFrame:
    """The wire as a table, of literals: a list of the driver's would start Python in the executors."""
    ends = (F.lit(float(v)).alias(c) for c, v in zip(("ax", "ay", "bx", "by"), WIRE, strict=True))
    return spark.range(1).select(F.lit("w").alias("boundary_id"), *ends, F.lit("BIDIRECTIONAL").alias("direction"), F.lit(True).alias("is_active"))


RANK_SQL = """, a AS (SELECT *, CASE WHEN value >= 85 THEN 3 WHEN value >= 50 THEN 2 ELSE 1 END AS rank FROM x),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY rank DESC, event_id) AS top FROM a) WHERE top = 1),
    u AS (SELECT user_id AS key, s, event_id, rank, coalesce(rank > lag(rank) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS rises FROM t)"""


@query("str06_operator_alerts", recursive(RANK_SQL + greedy_sql("SELECT * FROM u", 43200, "n.rises", "SELECT g.event_id, u.rank FROM g JOIN u ON u.event_id = g.event_id WHERE emitted")), False)
def str06(spark: S, d: str) -> DataFrame:
    rank = F.when(F.col("value") >= 85, 3).when(F.col("value") >= 50, 2).otherwise(1)
    return zones.operator_alerts(observations(spark, d).withColumn("rank", rank), ["user_id"], "ts", "event_id", "rank", 43200.0).select("event_id", "rank")


@query("str08_debounce", recursive(greedy_sql("SELECT user_id AS key, s, event_id FROM x", 86400)), False)
def str08(spark: S, d: str) -> DataFrame:
    return folds.emit_with_cooldown(table(spark, d, "events"), ["user_id"], "ts", "event_id", 86400.0).select("event_id")


@query("str16_embedding_samples", recursive(greedy_sql("SELECT user_id * 100 + camera_id AS key, s, event_id FROM x WHERE event_type = 'view'", 172800)), False)
def str16(spark: S, d: str) -> DataFrame:
    rows = observations(spark, d).where("event_type = 'view'")
    return folds.emit_with_cooldown(rows, ["user_id", "camera_id"], "ts", "event_id", 172800.0).select("event_id")


SESSION_SQL = """, g AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 21600 THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS incident FROM g),
  a AS (SELECT user_id, CAST(incident AS BIGINT) AS incident, count(*) AS n_events, min(ts) AS first_seen, max(ts) AS last_seen, max(value) AS peak_threat, arg_max(value, (ts, event_id)) AS current_threat,
    count(*) FILTER (WHERE value >= 30) AS qualifying, arg_min(value, (ts, event_id)) FILTER (WHERE value >= 30) AS alert_score FROM i GROUP BY user_id, incident)
"""


@query(
    "str09_incident_sessions",
    SESSION_SQL
    + """SELECT user_id, incident, n_events, first_seen, last_seen, peak_threat, current_threat, qualifying,
      CASE WHEN peak_threat >= 85 THEN 'CRITICAL' WHEN peak_threat >= 70 THEN 'HIGH' WHEN peak_threat >= 50 THEN 'MEDIUM' WHEN peak_threat >= 30 THEN 'LOW' ELSE 'INFO' END AS severity,
      CASE WHEN peak_threat >= 70 THEN 'ESCALATED' WHEN n_events > 1 THEN 'ACTIVE' ELSE 'DETECTED' END AS status,
      CASE WHEN qualifying = 0 THEN NULL WHEN alert_score >= 85 THEN 'CRITICAL' WHEN alert_score >= 70 THEN 'HIGH' ELSE 'MEDIUM' END AS alert_severity,
      greatest(n_events - CASE WHEN qualifying > 0 THEN 1 ELSE 0 END, 0) AS suppressed FROM a""",
)
def str09(spark: S, d: str) -> DataFrame:
    numbered = incidents.numbered_incidents(table(spark, d, "events"), ["user_id"], "ts", "event_id", 21600.0)
    return incidents.incidents(numbered, ["user_id"], "ts", "event_id", "value")


@query("agg15_dedup_rate", SESSION_SQL + "SELECT sum(n_events) AS n_events, count(*) AS n_incidents, count(*) FILTER (WHERE qualifying > 0) AS n_alerts, round(100.0 * (sum(n_events) - count(*) FILTER (WHERE qualifying > 0)) / sum(n_events), 1) AS suppression_rate FROM a")
def agg15(spark: S, d: str) -> DataFrame:
    return incidents.suppression(str09(spark, d))


@query("str11_one_alert", SESSION_SQL + "SELECT sum(n_events) AS n_events, count(*) AS n_incidents, count(*) FILTER (WHERE qualifying > 0) AS n_alerts, round(100.0 * (sum(n_events) - count(*) FILTER (WHERE qualifying > 0)) / sum(n_events), 1) AS suppression_rate FROM a")
def str11(spark: S, d: str) -> DataFrame:
    return incidents.suppression(str09(spark, d))


@query("str12_coordinated")
def str12(spark: S, d: str) -> DataFrame:
    x = observations(spark, d)
    return frames.coordinated_groups(x.select("camera_id", "k", F.col("event_id").alias("track_id"), "x", "y", "vx", "vy"), ["camera_id", "k"])


FOLLOW_SQL = """, y AS (SELECT *, user_id AS entity, 'CAM-' || (k % 5) AS camera, 'T-' || (k % 7) AS track FROM x),
    e AS (SELECT entity, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN entity % 10 <> 9 THEN arg_max(camera, (ts, event_id)) END AS camera, CASE WHEN entity % 4 = 0 THEN arg_max(track, (ts, event_id)) END AS track FROM y GROUP BY entity),
    l AS (SELECT entity, camera, track, min(ts) AS first_seen, max(ts) AS last_seen FROM y WHERE entity % 3 = 0 OR entity % 11 = 1 AND k % 35 = 1 GROUP BY ALL),
    t AS (SELECT * FROM (SELECT entity, lag(camera) OVER w AS f, lag(track) OVER w AS ft, camera AS c, track AS ct, value / 100 AS confidence, ts AS moved, event_id AS seq FROM y WHERE event_type = 'signup' WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)) WHERE f <> c AND entity % 3 <> 2),
    h AS (SELECT e.*, (SELECT count(*) FROM t WHERE t.entity = e.entity) AS moves, (SELECT count(*) FROM l WHERE l.entity = e.entity) AS tracks FROM e),
    c AS (SELECT t.*, h.first_seen, row_number() OVER w AS n, coalesce(lead(moved) OVER w, h.last_seen) AS later FROM t JOIN h ON h.entity = t.entity AND moves > 0 AND tracks <= 1 WINDOW w AS (PARTITION BY t.entity ORDER BY moved, seq)),
    r AS (SELECT l.*, row_number() OVER (PARTITION BY l.entity ORDER BY l.first_seen, l.camera, l.track) AS n FROM l JOIN h ON h.entity = l.entity AND NOT (moves > 0 AND tracks <= 1)),
    a AS (SELECT entity, c AS camera, ct AS track, arg_min(f, (moved, seq)) AS f, arg_min(confidence, (moved, seq)) AS confidence FROM t GROUP BY ALL),
    hops AS (SELECT entity, 1 AS hop, f AS camera, ft AS track, first_seen AS entered, moved AS last_seen, 1.0 AS confidence, NULL AS from_camera FROM c WHERE n = 1
      UNION ALL SELECT entity, n + 1, c, ct, moved, later, confidence, f FROM c
      UNION ALL SELECT entity, 1, camera, coalesce(track, 'LOCAL-1'), first_seen, last_seen, 1.0, NULL FROM h WHERE tracks = 0 AND moves = 0 AND camera IS NOT NULL
      UNION ALL SELECT r.entity, r.n, r.camera, r.track, r.first_seen, r.last_seen, CASE WHEN r.n > 1 THEN coalesce(a.confidence, 1.0) ELSE 1.0 END, CASE WHEN r.n > 1 THEN a.f END FROM r LEFT JOIN a ON a.entity = r.entity AND a.camera = r.camera AND a.track = r.track)
    SELECT entity, hop, camera, track, entered, greatest(0, epoch_us(last_seen) - epoch_us(entered)) AS duration_us, round(confidence, 4) AS confidence, from_camera FROM hops"""


@query("str18_follow_track", FOLLOW_SQL)
def str18(spark: S, d: str) -> DataFrame:
    k, e = F.col("k"), F.col("entity")
    y = observations(spark, d).withColumns({"entity": F.col("user_id"), "camera": F.concat(F.lit("CAM-"), k % 5), "track": F.concat(F.lit("T-"), k % 7)})
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    entities = y.groupBy("entity").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), last("camera").alias("camera"), last("track").alias("track"))
    entities = entities.withColumns({"camera": F.when(e % 10 != 9, F.col("camera")), "track": F.when(e % 4 == 0, F.col("track"))})
    seen = y.where("entity % 3 = 0 OR entity % 11 = 1 AND k % 35 = 1")
    tracks = seen.groupBy("entity", "camera", "track").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    w = Window.partitionBy("entity").orderBy("ts", "event_id")
    moved = y.where("event_type = 'signup'").select(
        "entity", F.lag("camera").over(w).alias("from_camera"), F.lag("track").over(w).alias("from_track"), F.col("camera").alias("to_camera"), F.col("track").alias("to_track"),
        (F.col("value") / 100).alias("confidence"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )
    found = reports.followed(entities, moved.where("from_camera <> to_camera AND entity % 3 <> 2"), tracks)
    return found.select("entity", "hop", "camera", "track", "entered", F.round(F.col("duration") * 1e6).cast("long").alias("duration_us"), F.round("confidence", 4).alias("confidence"), "from_camera")


def boxes(spark: S, d: str) -> DataFrame:
    x = observations(spark, d)
    return x.select("camera_id", "k", "event_id", F.col("event_type").alias("class_name"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), "x", "y").selectExpr(
        "camera_id", "k", "event_id", "CASE WHEN class_name IN ('click', 'view') THEN 'car' ELSE 'truck' END AS class_name", "confidence", "x AS x1", "y AS y1", "x + 300 AS x2", "y + 300 AS y2"
    )


@query("str24_cross_class")
def str24(spark: S, d: str) -> DataFrame:
    return frames.without_cross_class_duplicates(boxes(spark, d), ["camera_id", "k"]).select("event_id")


@query("str25_track_duplicates")
def str25(spark: S, d: str) -> DataFrame:
    return frames.without_track_duplicates(boxes(spark, d), ["camera_id", "k"]).select("event_id")


@query("str26_nms")
def str26(spark: S, d: str) -> DataFrame:
    return frames.nms(boxes(spark, d), ["camera_id", "k"]).select("event_id")


@query("str29_occupancy", INSIDE_SQL + "SELECT 'square' AS zone_id, count(*) FILTER (WHERE i) AS occupied FROM (SELECT user_id, arg_max(inside, (ts, event_id)) AS i FROM z GROUP BY user_id)")
def str29(spark: S, d: str) -> DataFrame:
    return zones.occupancy(inside(spark, d), ["user_id"], "ts", "event_id")


@query(
    "agg20_majority",
    "SELECT user_id, arg_max(event_type, (n, oldest)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n, max(place) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM x) WHERE place <= 20 GROUP BY user_id, event_type) GROUP BY user_id",
)
def agg20(spark: S, d: str) -> DataFrame:
    last = folds.last_rows(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 20)
    votes = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    return votes.select("user_id", folds.majority_vote(F.transform("l", lambda r: r["event_type"])).alias("event_type"))


NUMBERED_SQL = ", n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM x)"


@query(
    "mth03_smoothed",
    recursive(
        NUMBERED_SQL.format(key="user_id")
        + """, g AS (SELECT user_id, i, value AS v FROM n WHERE i = 1
      UNION ALL SELECT n.user_id, n.i, 0.4 * n.value + 0.6 * g.v FROM g JOIN n ON n.user_id = g.user_id AND n.i = g.i + 1)
    SELECT user_id, round(arg_max(v, i), 6) AS smoothed FROM g GROUP BY user_id"""
    ),
    False,
)
def mth03(spark: S, d: str) -> DataFrame:
    smoothed = folds.last_smoothed(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 0.4)
    return smoothed.select("user_id", F.round("smoothed", 6).alias("smoothed"))


@query(
    "scr11_tamper_alarm",
    recursive(
        NUMBERED_SQL.format(key="camera_id")
        + """, g AS (SELECT camera_id, i, CASE WHEN k > 40 THEN 1 ELSE 0 END AS level FROM n WHERE i = 1
      UNION ALL SELECT n.camera_id, n.i, CASE WHEN n.k > 40 THEN g.level + 1 ELSE greatest(g.level - 1, 0) END FROM g JOIN n ON n.camera_id = g.camera_id AND n.i = g.i + 1)
    SELECT camera_id, count(*) FILTER (WHERE level >= 3) AS alarms FROM g GROUP BY camera_id"""
    ),
    False,
)
def scr11(spark: S, d: str) -> DataFrame:
    rows = observations(spark, d).withColumn("bad", F.col("k") > 40)
    return folds.leaky_alarms(rows, ["camera_id"], ["ts", "event_id"], "bad").groupBy("camera_id").agg(F.count_if("alarm").alias("alarms"))
