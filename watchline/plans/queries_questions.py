"""The questions over events as queries: each parses its question and gives the rows that answer it."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchline.operators.events import newest_in_order
from watchline.plans.base import observations, query
from watchline.questions.answers import is_greeting, parsed, refusal_kind, rows_for, summary_for
from watchline.sources.tables import table

S = SparkSession
NOW = datetime(2024, 1, 15, 12, 0, tzinfo=timezone.utc)
TYPES, CLASSES, MOVES, MESSAGES = ["TRACKING", "ZONE", "ALERT", "TRACKING"], ["person", "car", "truck", "dog"], ["entered", "exited", "crossed", "loitering"], ["", "night watch", "Dark corner"]

#: SQL of the event-store rows that ``stored`` gives, as the common table q.
Q = f""", q AS (SELECT event_id AS seq_id, {TYPES}[k % 4 + 1] AS event_type, ts AS timestamp, 'CAM-' || (k % 5) AS camera_id,
    CAST(user_id AS VARCHAR) AS local_track_id, 'GLOBAL-PERSON-' || lpad(CAST(user_id AS VARCHAR), 3, '0') AS global_entity_id, 'zone_' || (user_id % 3) AS zone_id,
    {CLASSES}[user_id % 4 + 1] AS entity_type, {CLASSES}[(user_id + k // 50) % 4 + 1] AS object_class, x, y, vx, vy, k / 4.0 AS speed, k * 3.0 AS direction, {MOVES}[event_id % 4 + 1] AS transition, {MESSAGES}[event_id % 3 + 1] AS message, k / 2.0 AS dwell FROM x)
"""


def stored(spark: S, d: str) -> DataFrame:
    """Events as the event store has them, with their payload as JSON."""
    of = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))
    k, user, e = F.col("k"), F.col("user_id"), F.col("event_id")
    payload = F.struct(of(MOVES, e).alias("transition"), of(MESSAGES, e).alias("message"), (k / 2).alias("dwell_duration_seconds"), of(CLASSES, user + F.floor(k / 50)).alias("object_class"), F.array("x", "y").alias("position"), F.array("vx", "vy").alias("velocity"), (k / 4).alias("speed"), (k * 3.0).alias("direction"))
    return observations(spark, d).select(
        e.alias("seq_id"), e.cast("string").alias("event_id"), of(TYPES, k).alias("event_type"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("CAM-"), k % 5).alias("camera_id"), user.cast("string").alias("local_track_id"),
        F.concat(F.lit("GLOBAL-PERSON-"), F.lpad(user.cast("string"), 3, "0")).alias("global_entity_id"),
        F.concat(F.lit("zone_"), user % 3).alias("zone_id"), of(CLASSES, user).alias("entity_type"), F.to_json(payload).alias("metadata"),
    )


def asked(spark: S, d: str, question: str) -> DataFrame:
    return rows_for(parsed(question, NOW), stored(spark, d)).select("seq_id", "event_type", "camera_id")


def newest(condition: str, limit: int) -> str:
    return Q + f"SELECT seq_id, event_type, camera_id FROM (SELECT * FROM q WHERE {condition} ORDER BY timestamp DESC, seq_id DESC LIMIT {limit})"


def last_states(kinds: str) -> str:
    return Q + f"SELECT camera_id, count(*) AS n FROM (SELECT camera_id, local_track_id, arg_max(entity_type, (timestamp, seq_id)) AS c FROM q GROUP BY camera_id, local_track_id) WHERE c IN ({kinds}) GROUP BY camera_id"


#: Questions answered by single events: name, question, and the SQL's condition and limit.
EVENTS = [
    ("nlq07_breaches", "any perimeter breach?", "event_type = 'ALERT'", 10),
    ("nlq08_recent_history", "what happened in the last 6 hours", "timestamp BETWEEN '2024-01-15 06:00' AND '2024-01-15 12:00'", 10),
    ("nlq12_track_entry", "when did track 7 enter?", "local_track_id = '7' AND event_type = 'ZONE' AND transition = 'entered'", 1000),
    ("nlq12_track_exit", "when did track 7 leave?", "local_track_id = '7' AND event_type = 'ZONE' AND transition = 'exited'", 1000),
    ("nlq15_track_story", "tell me about track 7", "local_track_id = '7'", 100),
    ("nlq16_alert_explanation", "why was there an alert on CAM-2", "event_type = 'ALERT' AND camera_id = 'CAM-2'", 5),
    ("nlq18_night", "anything in the dark", "event_type = 'ALERT' AND regexp_matches(lower(message), 'night|dark')", 20),
    ("nlq19_crossings", "who crossed the fence", "event_type = 'ZONE' AND transition = 'crossed'", 2000),
    ("nlq20_highest_risk", "highest risk", "event_type = 'ALERT'", 1),
]
for _name, _question, _condition, _limit in EVENTS:
    query(_name, newest(_condition, _limit))(lambda spark, d, question=_question: asked(spark, d, question))

#: Questions answered by counts: name, question, and SQL.
COUNTS = [
    ("nlq04_live_people", "how many people are visible", last_states("'person'")),
    ("nlq04_live_vehicles", "how many vehicles", last_states("'car', 'truck'")),
    ("nlq05_busiest_camera", "busiest camera", last_states("'person', 'car', 'truck', 'dog'") + " ORDER BY n DESC, camera_id LIMIT 1"),
    (
        "nlq11_follow_entity",
        "follow person-7",
        Q + "SELECT entity, row_number() OVER (ORDER BY timestamp, seq_id) AS hop, before AS from_camera, camera_id AS camera, timestamp AS arrived, coalesce(lead(timestamp) OVER (ORDER BY timestamp, seq_id), last) AS left "
        "FROM (SELECT 'GLOBAL-PERSON-007' AS entity, *, lag(camera_id) OVER (ORDER BY timestamp, seq_id) AS before, max(timestamp) OVER () AS last FROM q WHERE global_entity_id = 'GLOBAL-PERSON-007') WHERE before IS NULL OR before <> camera_id",
    ),
]
for _name, _question, _sql in COUNTS:
    query(_name, _sql)(lambda spark, d, question=_question: summary_for(parsed(question, NOW), stored(spark, d)))



def cut(condition: str, limit: int) -> str:
    """SQL of the newest rows that a question takes, as the table n."""
    return Q + f", n AS (SELECT * FROM q WHERE {condition} ORDER BY timestamp DESC, seq_id DESC LIMIT {limit})\n"


THREAT_SQL = Q + """, e AS (SELECT *, lower(concat_ws(' ', message, '', transition, '', '')) AS words FROM q WHERE timestamp <= TIMESTAMP '2024-01-15 12:00'),
    a AS (SELECT * FROM (SELECT * FROM e WHERE event_type = 'ALERT' ORDER BY timestamp DESC, seq_id DESC LIMIT 50) WHERE timestamp >= TIMESTAMP '2024-01-15 06:00'), o AS (SELECT * FROM e WHERE timestamp >= TIMESTAMP '2024-01-15 06:00' ORDER BY timestamp DESC, seq_id DESC LIMIT 200),
    c AS (SELECT count(*) FILTER (WHERE contains(words, 'crossed')) AS critical, count(*) FILTER (WHERE contains(words, 'loiter')) AS loitering FROM a), t AS (SELECT count(DISTINCT local_track_id) AS tracks, bool_or(event_type = 'ZONE' AND contains(words, 'crossed')) AS crossed FROM o),
    r AS (SELECT critical, 0 AS restricted, loitering, tracks, 35.0 * critical + 20.0 * loitering + CASE WHEN tracks > 1 AND (crossed OR critical > 0) THEN 10 ELSE 0 END AS total FROM c, t WHERE tracks > 0)
    SELECT 'all' AS sector, critical, restricted, loitering, tracks, total::DOUBLE AS raw, least(100.0, total)::DOUBLE AS score, CASE WHEN total >= 60 THEN 'CRITICAL' WHEN total >= 25 THEN 'RESTRICTED' ELSE 'NORMAL' END AS level FROM r"""

#: Questions answered by what is configured or by what is worked out of events: name, question, and SQL.
WORKED_OUT = [
    ("nlq03_live_cameras", "how many cameras are active", last_states("'person', 'car', 'truck', 'dog'").replace("SELECT camera_id, count(*)", ", l AS (SELECT camera_id, count(*)", 1) + ") SELECT 'CAM-' || n_nationkey AS camera_id, CASE WHEN n_regionkey < 3 THEN 'ONLINE' ELSE 'OFFLINE' END AS status, coalesce(n, 0) AS n FROM nation LEFT JOIN l ON l.camera_id = 'CAM-' || n_nationkey"),
    ("nlq06_threat_status", "threat status in the last 6 hours", THREAT_SQL),
    ("nlq09_zones", "list zones", Q + "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'tripwire' ELSE 'zone' END AS kind, 'zone_' || s_suppkey AS zone_id, s_name AS name, CASE WHEN s_nationkey > 12 THEN 'critical' ELSE 'restricted' END AS severity, s_acctbal > 0 AS is_active FROM supplier"),
    ("nlq10_system_status", "system status", Q + "SELECT count(*) AS workers, count(*) FILTER (WHERE c_acctbal > 0) AS workers_running, coalesce(sum(c_custkey % 7) FILTER (WHERE c_acctbal > 0), 0) AS active_tracks, coalesce(sum(c_custkey) FILTER (WHERE c_acctbal > 0), 0) AS frames_processed, coalesce(round(avg(c_nationkey * 1.5) FILTER (WHERE c_acctbal > 0), 2), 0) AS display_fps, coalesce(round(avg(c_nationkey * 0.5) FILTER (WHERE c_acctbal > 0), 2), 0) AS ai_fps FROM customer"),
    ("nlq14_track_movement", "which direction was track 7 moving", cut("local_track_id = '7' AND event_type = 'TRACKING'", 1000) + "SELECT seq_id, x, y, vx, vy, speed::DOUBLE AS speed, direction::DOUBLE AS direction FROM n ORDER BY timestamp DESC, seq_id DESC LIMIT 1"),
    ("nlq17_vehicles", "any truck or plate yesterday", cut("event_type = 'TRACKING' AND timestamp BETWEEN '2024-01-14' AND '2024-01-15'", 100) + "SELECT local_track_id, arg_max(object_class, (timestamp, seq_id)) AS last_object_class FROM n WHERE object_class IN ('car', 'truck') GROUP BY local_track_id"),
    ("nlq21_zone_story", "who entered yesterday", Q + "SELECT count(*) AS n, count(DISTINCT local_track_id) AS tracks FROM q WHERE event_type = 'ZONE' AND timestamp BETWEEN '2024-01-14' AND '2024-01-15' HAVING count(*) > 0"),
    ("nlq22_camera_summary", "show CAM-3 in the last 3 days", cut("camera_id = 'CAM-3' AND timestamp BETWEEN '2024-01-12 12:00' AND '2024-01-15 12:00'", 100) + "SELECT event_type, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM n GROUP BY event_type"),
]


def worked_out(spark: S, d: str, question: str) -> DataFrame:
    """With nations for cameras, suppliers for zones and tripwires, and customers for workers."""
    nation, supplier, customer = (table(spark, d, name) for name in ("nation", "supplier", "customer"))
    key = F.col("c_custkey")
    cameras = nation.select(F.concat(F.lit("CAM-"), F.col("n_nationkey")).alias("camera_id"), F.when(F.col("n_regionkey") < 3, "ONLINE").otherwise("OFFLINE").alias("status"))
    zones = supplier.select(
        F.when(F.col("s_suppkey") % 4 == 0, "tripwire").otherwise("zone").alias("kind"), F.concat(F.lit("zone_"), F.col("s_suppkey")).alias("zone_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") > 12, "critical").otherwise("restricted").alias("severity"), (F.col("s_acctbal") > 0).alias("is_active"),
    )
    workers = customer.select((F.col("c_acctbal") > 0).alias("running"), (F.col("c_nationkey") * 1.5).alias("display_fps"), (F.col("c_nationkey") * 0.5).alias("ai_fps"), (key % 7).alias("active_tracks"), key.alias("frames_processed"))
    return summary_for(parsed(question, NOW), stored(spark, d), NOW, cameras, zones, workers)


for _name, _question, _sql in WORKED_OUT:
    query(_name, _sql)(lambda spark, d, question=_question: worked_out(spark, d, question))

ASKED = ["Who is this person?", "hello!", "Any gun on CAM-1?", "How long did track 7 stay?", "hostile intent?", "same person on cam 2", "SELECT * from events", "Good morning", "busiest camera", "drop table events"]


def questions(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", F.element_at(F.array(*(F.lit(a) for a in ASKED)), (F.col("k") % len(ASKED) + 1).cast("int")).alias("question"))


@query("nlq01_refusals", f"SELECT event_id, ['identity', NULL, 'weapon', NULL, 'intent', 'cross_camera_identity', 'sql', NULL, NULL, 'sql'][k % {len(ASKED)} + 1] AS kind FROM x")
def nlq01(spark: S, d: str) -> DataFrame:
    return questions(spark, d).select("event_id", refusal_kind(F.col("question")).alias("kind"))


@query("nlq02_greetings", f"SELECT event_id, k % {len(ASKED)} IN (1, 7) AS greeting FROM x")
def nlq02(spark: S, d: str) -> DataFrame:
    return questions(spark, d).select("event_id", is_greeting(F.col("question")).alias("greeting"))


@query("nlq13_track_dwell", Q + "SELECT max(dwell) AS longest FROM (SELECT * FROM q WHERE local_track_id = '7' AND event_type = 'ZONE' ORDER BY timestamp DESC, seq_id DESC LIMIT 1000)")
def nlq13(spark: S, d: str) -> DataFrame:
    rows = rows_for(parsed("how long did track 7 stay", NOW), stored(spark, d))
    return rows.agg(F.max(F.get_json_object("metadata", "$.dwell_duration_seconds").cast("double")).alias("longest"))


@query(
    "nlq23_primitives",
    Q + "SELECT 'track' AS kind, seq_id FROM (SELECT * FROM q WHERE local_track_id = '7' ORDER BY timestamp DESC, seq_id DESC LIMIT 1000) UNION ALL SELECT 'zone', seq_id FROM (SELECT * FROM q WHERE event_type = 'ZONE' ORDER BY timestamp DESC, seq_id DESC LIMIT 2000) "
    "UNION ALL SELECT 'camera', seq_id FROM (SELECT * FROM q WHERE camera_id = 'CAM-1' ORDER BY timestamp DESC, seq_id DESC LIMIT 500) UNION ALL SELECT 'alerts', seq_id FROM (SELECT * FROM q WHERE event_type = 'ALERT' ORDER BY timestamp DESC, seq_id DESC LIMIT 20)",
)
def nlq23(spark: S, d: str) -> DataFrame:
    """The bounded reads that all answers are made of, newest first."""
    e = stored(spark, d)
    reads = [("track", F.col("local_track_id") == "7", 1000), ("zone", F.col("event_type") == "ZONE", 2000), ("camera", F.col("camera_id") == "CAM-1", 500), ("alerts", F.col("event_type") == "ALERT", 20)]
    parts = [newest_in_order(e.where(c), "timestamp", "seq_id", n).select(F.lit(kind).alias("kind"), "seq_id") for kind, c, n in reads]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
