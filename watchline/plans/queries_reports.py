"""Queries of assessments, profiles, alert items, links, movement, rounding, extraction and presets, to the whole of what they give."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchline.functions import geo, kinematics, numbers, scoring, text
from watchline.operators import events as ev
from watchline.operators import joins, reports
from watchline.plans.base import observations, query
from watchline.plans.queries_events import ASOF_SQL
from watchline.plans.queries_functions import SQUARE, WIRE, crossing_sql, trajectories
from watchline.questions.times import clock, time_span
from watchline.sources import definitions
from watchline.sources.tables import table

S = SparkSession


def one_of(values: list, at) -> F.Column:
    """The value at a place, counted round."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


KINDS, MESSAGES, MOVES = ["ALERT", "TRACKING", "ZONE", "ALERT", "SYSTEM"], ["", "Fence crossed", "night watch", None, "Loitering at gate", "near checkpoint"], ["entered", "exited", "crossed", None]
NAMES, SEVERITIES = ["Restricted strip", "Gate", None, "Protected yard"], ["critical", "RESTRICTED", "", None, "normal"]
SECTOR_SQL = f""", e AS (SELECT event_id, ts, camera_id, user_id, {sql_list(KINDS)}[k % 5 + 1] AS event_type, lower(concat_ws(' ', coalesce({sql_list(MESSAGES)}[event_id % 6 + 1], ''), '', coalesce({sql_list(MOVES)}[event_id % 4 + 1], ''), coalesce({sql_list(NAMES)}[user_id % 4 + 1], ''), '')) AS words,
      upper(coalesce(nullif({sql_list(SEVERITIES)}[event_id % 7 % 5 + 1], ''), '')) AS severity FROM x),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE event_type = 'ALERT') WHERE n <= 50 AND ts >= TIMESTAMP '2024-01-26 00:00:00'),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE ts >= TIMESTAMP '2024-01-26 00:00:00') WHERE n <= 200),
    ca AS (SELECT camera_id, count(*) FILTER (WHERE contains(words, 'crossed') OR contains(words, 'breach') OR contains(words, 'tripwire') OR contains(severity, 'CRITICAL')) AS critical, count(*) FILTER (WHERE contains(words, 'restricted') OR contains(severity, 'RESTRICTED')) AS restricted,
      count(*) FILTER (WHERE contains(words, 'loiter') OR contains(words, 'dwelling')) AS loitering, bool_or(contains(words, 'protected') OR contains(words, 'checkpoint')) AS protected FROM a GROUP BY camera_id),
    co AS (SELECT camera_id, count(DISTINCT user_id) AS tracks, bool_or(event_type = 'ZONE' AND contains(words, 'crossed')) AS crossed, bool_or(event_type = 'ZONE' AND contains(words, 'entered') AND (contains(words, 'restricted') OR contains(words, 'critical'))) AS intruded, bool_or(event_type = 'ZONE' AND contains(words, 'protected')) AS zone FROM o GROUP BY camera_id),
    r AS (SELECT co.camera_id, coalesce(critical, 0) AS critical, coalesce(restricted, 0) AS restricted, coalesce(loitering, 0) AS loitering, tracks, 35.0 * coalesce(critical, 0) + 30.0 * coalesce(restricted, 0) + 20.0 * coalesce(loitering, 0)
      + CASE WHEN coalesce(protected, false) OR zone THEN 15 ELSE 0 END + CASE WHEN tracks > 1 AND (crossed OR intruded OR coalesce(critical, 0) > 0 OR coalesce(restricted, 0) > 0) THEN 10 ELSE 0 END AS total FROM co LEFT JOIN ca ON ca.camera_id = co.camera_id)
    SELECT camera_id, critical, restricted, loitering, tracks, total::DOUBLE AS raw, greatest(0.0, least(100.0, total))::DOUBLE AS score, CASE WHEN total >= 60 THEN 'CRITICAL' WHEN total >= 25 THEN 'RESTRICTED' ELSE 'NORMAL' END AS level FROM r"""


@query("agg10_sector_threat", SECTOR_SQL)
def agg10(spark: S, d: str) -> DataFrame:
    """Each camera's threat over the last five days: of the newest 50 alerts, and the newest 200 events."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = observations(spark, d).select(
        "event_id", "ts", "camera_id", "user_id", one_of(KINDS, F.col("k")).alias("event_type"), one_of(MESSAGES, e).alias("message"), F.lit(None).cast("string").alias("narrative"), one_of(MOVES, e).alias("transition"),
        one_of(NAMES, u).alias("zone_name"), F.lit(None).cast("string").alias("zone_severity"), one_of(SEVERITIES, e % 7).alias("severity"),
    )
    return reports.sector_assessment(rows, "camera_id", "user_id", "ts", "event_id", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 5 * 86400.0)


PROFILE_SQL = """, places AS (SELECT DISTINCT user_id, camera, track FROM (SELECT user_id, 'C' || (k % 3) AS camera, 'T' || (k % 4) AS track FROM x WHERE event_type IN ('click', 'view')
      UNION ALL SELECT user_id, 'C' || (arg_max(k, (ts, event_id)) % 5), 'T' || (arg_max(k, (ts, event_id)) % 4) FROM x GROUP BY user_id)),
    c AS (SELECT user_id, string_agg(camera, ',' ORDER BY camera) AS cameras, string_agg(camera || ':' || t, ';' ORDER BY camera) AS local_tracks FROM (SELECT user_id, camera, string_agg(track, '+' ORDER BY track) AS t FROM places GROUP BY ALL) GROUP BY user_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM x WHERE event_type IN ('view', 'error')),
    p AS (SELECT user_id, string_agg(event_id, ',' ORDER BY n) FILTER (WHERE event_type = 'view') AS faces, string_agg(event_id, ',' ORDER BY n) FILTER (WHERE event_type = 'error') AS incidents, max(value) FILTER (WHERE event_type = 'error') AS peak FROM n WHERE n <= 10 GROUP BY user_id),
    t AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS transitions FROM x GROUP BY user_id)
    SELECT user_id, cameras, local_tracks, coalesce(faces, '') AS faces, coalesce(incidents, '') AS incidents, transitions, coalesce(peak, 0.0)::DOUBLE AS peak_threat,
      CASE WHEN peak >= 85 THEN 'CRITICAL' WHEN peak >= 70 THEN 'HIGH' WHEN peak >= 50 THEN 'MEDIUM' WHEN peak >= 30 THEN 'LOW' ELSE 'NORMAL' END AS threat_level FROM t LEFT JOIN c USING (user_id) LEFT JOIN p USING (user_id)"""


@query("agg17_entity_profile", PROFILE_SQL)
def agg17(spark: S, d: str) -> DataFrame:
    x = observations(spark, d).withColumnRenamed("user_id", "entity")
    k = F.col("k")
    last = x.groupBy("entity").agg(F.max_by("k", F.struct("ts", "event_id")).alias("k"))
    entities = last.select("entity", F.concat(F.lit("C"), k % 5).alias("camera"), F.concat(F.lit("T"), k % 4).alias("track"))
    tracks = x.where("event_type IN ('click', 'view')").select("entity", F.concat(F.lit("C"), k % 3).alias("camera"), F.concat(F.lit("T"), k % 4).alias("track"))
    faces = x.where("event_type = 'view'").select("entity", F.col("event_id").alias("face_id"), F.col("ts").alias("at"))
    incidents = x.where("event_type = 'error'").select("entity", F.col("event_id").alias("incident_id"), F.col("ts").alias("at"), F.col("value").alias("peak"))
    rows = reports.person_profiles(entities, tracks, faces, incidents, x.where("event_type = 'signup'"))
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    by_camera = F.transform(F.map_entries("local_tracks"), lambda m: F.concat(m["key"], F.lit(":"), F.array_join(m["value"], "+")))
    return rows.select(F.col("entity").alias("user_id"), joined("cameras").alias("cameras"), F.array_join(by_camera, ";").alias("local_tracks"), joined("faces").alias("faces"), joined("incidents").alias("incidents"), "transitions", "peak_threat", "threat_level")


@query("agg18_best_plate", "SELECT o_custkey AS entity, string_agg('P' || (o_orderkey % 97), ',' ORDER BY o_totalprice DESC, o_orderkey) AS plates, 'P' || (arg_max(o_orderkey, (o_totalprice, -o_orderkey)) % 97) AS best_plate, max(o_totalprice) AS best_confidence FROM orders GROUP BY o_custkey", False)
def agg18(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.concat(F.lit("P"), F.col("o_orderkey") % 97).alias("plate"), F.col("o_totalprice").alias("confidence"), F.col("o_orderkey").alias("observation_id"))
    return reports.vehicle_plates(o).withColumn("plates", F.array_join("plates", ","))


@query("scr05_profile_level", "SELECT event_id, CASE WHEN value >= 85 THEN 'CRITICAL' WHEN value >= 70 THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM' WHEN value >= 30 THEN 'LOW' ELSE 'NORMAL' END AS level FROM x")
def scr05(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scoring.band(F.col("value"), scoring.PROFILE_LEVELS, "NORMAL").alias("level"))


@query(
    "prj02_alert_defaults",
    """, p AS (SELECT *, k % 9 = 0 AS broken FROM x)
    SELECT event_id, CASE WHEN k % 4 = 1 THEN 'own' WHEN NOT broken AND k % 3 = 0 THEN 'told' ELSE 'Security Perimeter Violation' END AS message, CASE WHEN k % 5 = 2 THEN 'LOW' WHEN NOT broken AND k % 2 = 0 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
      k % 7 = 3 OR (NOT broken AND k % 6 = 0) AS is_acknowledged, CASE WHEN NOT broken THEN value END AS threat_score, CASE WHEN NOT broken THEN event_type END AS threat_level, CASE WHEN NOT broken THEN 'a;b' END AS threat_reasons, CASE WHEN NOT broken THEN 'c' END AS causal_chain,
      CASE WHEN NOT broken AND k % 2 = 1 THEN 'e/' || event_id END AS evidence_snapshot_uri, NULL AS face_snapshot_uri, CASE WHEN NOT broken THEN 'p' || k END AS anpr_snapshot_uri, CASE WHEN NOT broken THEN k END AS best_frame_number, CASE WHEN NOT broken AND k % 8 = 4 THEN 'THERMAL' ELSE 'STANDARD' END AS modality,
      CASE WHEN NOT broken THEN k / 4.0 END AS timeline_offset_sec, CASE WHEN NOT broken THEN 'N' END AS heading, CASE WHEN NOT broken THEN 'Slow' END AS speed_description, CASE WHEN NOT broken THEN x + y END AS box, CASE WHEN NOT broken THEN 'KA' || k END AS plate_number,
      CASE WHEN NOT broken THEN k / 100.0 END AS plate_confidence, NOT broken AND k % 10 = 5 AS plate_uncertain, CASE WHEN NOT broken THEN k / 50.0 END AS face_confidence FROM p""",
)
def prj02(spark: S, d: str) -> DataFrame:
    k, when = F.col("k"), F.when
    payload = F.struct(
        when(k % 3 == 0, "told").alias("message"), when(k % 2 == 0, "high").alias("severity"), (k % 6 == 0).alias("is_acknowledged"), F.col("value").alias("threat_score"), F.col("event_type").alias("threat_level"), F.array(F.lit("a"), F.lit("b")).alias("threat_reasons"),
        F.array(F.lit("c")).alias("causal_chain"), when(k % 2 == 1, F.concat(F.lit("e/"), F.col("event_id"))).alias("evidence_snapshot_uri"), F.concat(F.lit("p"), k).alias("anpr_snapshot_uri"), k.alias("best_frame_number"), when(k % 8 == 4, "THERMAL").alias("modality"),
        (k / 4).alias("timeline_offset_sec"), F.lit("N").alias("heading"), F.lit("Slow").alias("speed_description"), F.array("x", "y").alias("target_bbox"), F.concat(F.lit("KA"), k).alias("plate_number"), (k / 100).alias("plate_confidence"),
        when(k % 10 == 5, True).alias("plate_uncertain"), (k / 50).alias("face_confidence"),
    )
    rows = observations(spark, d).select(
        "event_id", when(k % 4 == 1, "own").when(k % 4 == 2, "").alias("message"), when(k % 5 == 2, "low").alias("severity"), (k % 7 == 3).alias("is_acknowledged"), when(k % 9 == 0, "{broken").otherwise(F.to_json(payload)).alias("payload")
    )
    items = ev.alert_items(rows).withColumns({"box": F.col("target_bbox")[0] + F.col("target_bbox")[1], "threat_reasons": F.array_join("threat_reasons", ";"), "causal_chain": F.array_join("causal_chain", ";")})
    return items.drop("payload", "target_bbox").withColumn("best_frame_number", F.col("best_frame_number").cast("long"))


J15_SQL = ASOF_SQL.replace("SELECT entry_id, exit_id,", ", c AS (SELECT entry_id, exit_id,", 1).rstrip() + """),
    l AS (SELECT s_suppkey AS link, s_suppkey % 8 AS from_camera, s_nationkey % 8 AS to_camera, 'zone_' || s_nationkey AS target_zone FROM supplier)
    SELECT entry_id, from_camera, to_camera, link, target_zone FROM c LEFT JOIN (SELECT from_camera, to_camera, min(link) AS link, arg_min(target_zone, link) AS target_zone FROM l GROUP BY ALL) USING (from_camera, to_camera)"""


@query("j15_zone_lookup", J15_SQL)
def j15(spark: S, d: str) -> DataFrame:
    """Correlated moves with the zone of the first topology link between their cameras; suppliers stand for links."""
    x = observations(spark, d).withColumn("object_class", F.col("k") % 10)
    moves = joins.as_of_correlation(x.where("event_type = 'error'"), x.where("event_type = 'signup'"), most=3600.0)
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    links = table(spark, d, "supplier").select(s.alias("position"), s.alias("link"), (s % 8).alias("from_camera"), (n % 8).cast("long").alias("to_camera"), F.concat(F.lit("zone_"), n).alias("target_zone"))
    return joins.first_links(moves, links, "position").select("entry_id", "from_camera", "to_camera", "link", "target_zone")


MOVEMENT_SQL = """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM x),
    g AS (SELECT user_id, count(*) AS m, max(x) FILTER (WHERE n = 1) - arg_max(x, n) AS dx, max(y) FILTER (WHERE n = 1) - arg_max(y, n) AS dy FROM o WHERE n <= 5 GROUP BY user_id),
    v AS (SELECT *, greatest(1, m - 1) AS f, sqrt(dx * dx + dy * dy) AS dist, round(((degrees(atan2(dy, dx)) % 360) + 360) % 360, 1) AS angle FROM g),
    w AS (SELECT *, m < 2 OR dist < 1.0 * f OR dist = 0 AS still FROM v)
    SELECT user_id, round(CASE WHEN m < 2 THEN 0 ELSE dx / f END, 2) AS dx, round(CASE WHEN m < 2 THEN 0 ELSE dy / f END, 2) AS dy, round(CASE WHEN m < 2 THEN 0 ELSE dist END, 2) AS distance_px, CASE WHEN still THEN 0 ELSE angle END AS direction_deg,
      CASE WHEN still THEN 'STATIONARY' ELSE ['E', 'SE', 'S', 'SW', 'W', 'NW', 'N', 'NE'][CAST(floor((angle + 22.5) / 45) AS BIGINT) % 8 + 1] END AS cardinal_heading, CASE WHEN m < 2 THEN 0 ELSE round(dist / f, 2) END AS speed_px_per_frame, CASE WHEN m < 2 THEN 0 ELSE round(round(dist / f, 2) * 30, 2) END AS speed_px_per_sec, NOT still AS is_moving FROM w"""


@query("kin01_movement", MOVEMENT_SQL)
def kin01(spark: S, d: str) -> DataFrame:
    return trajectories(spark, d).select("user_id", kinematics.movement(F.col("p")).alias("m")).select("user_id", "m.*")


@query(
    "str13_influx",
    "SELECT event_id, round(slope, 3) AS slope FROM (SELECT event_id, n, regr_slope(CAST(n AS DOUBLE), t) OVER w AS slope, count(*) OVER w AS m, var_pop(t) OVER w AS spread FROM (SELECT *, event_id / 16.0 AS t, k % 12 AS n, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) AS i FROM x) "
    "WINDOW w AS (PARTITION BY camera_id ORDER BY t RANGE BETWEEN 10.0 PRECEDING AND CURRENT ROW)) WHERE m BETWEEN 3 AND 15 AND spread >= 0.000001 AND slope >= 0.40 AND n >= 3 "
    "UNION ALL SELECT event_id, round(slope, 3) FROM (SELECT event_id, camera_id, n, (SELECT regr_slope(CAST(b.k % 12 AS DOUBLE), b.event_id / 16.0) FROM (SELECT * FROM x b WHERE b.camera_id = a.camera_id AND b.event_id <= a.event_id ORDER BY b.event_id DESC LIMIT 15) b) AS slope "
    "FROM (SELECT *, k % 12 AS n, count(*) OVER (PARTITION BY camera_id ORDER BY event_id / 16.0 RANGE BETWEEN 10.0 PRECEDING AND CURRENT ROW) AS m FROM x) a WHERE m > 15) WHERE slope >= 0.40 AND n >= 3",
)
def str13(spark: S, d: str) -> DataFrame:
    """Cameras whose counts rise by 0.4 a second or more over the last ten seconds, at most fifteen samples."""
    rows = observations(spark, d).select("event_id", "camera_id", (F.col("event_id") / 16).alias("t"), (F.col("k") % 12).alias("n"))
    return reports.influx(rows, ["camera_id"], "t", "n").where("rapid").select("event_id", "slope")


@query("mth01_half_even", "SELECT event_id, CAST(printf('%.2f', event_id % 1000 / 200.0) AS DOUBLE) AS r, CAST(printf('%.1f', value * 1.05) AS DOUBLE) AS tenth, CAST(printf('%.0f', k % 3 + 0.5) AS DOUBLE) AS whole, 2.67::DOUBLE AS under_its_tie FROM x")
def mth01(spark: S, d: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    return observations(spark, d).select(
        "event_id", numbers.half_even(e % 1000 / 200, 2).alias("r"), numbers.half_even(F.col("value") * 1.05, 1).alias("tenth"), numbers.half_even(k % 3 + F.lit(0.5), 0).alias("whole"), numbers.half_even(F.lit(2.675), 2).alias("under_its_tie")
    )


QUESTIONS = ["where is track #7", "Track id T-9 now", "track the van", "on CAM_intel-2 please", "Camera #4 last 15 minutes", "any camera", "zone alpha last 2 hours", "sector 9, cam 3, last 30 sec", "nothing at all", "camera cctv_4 in area #b2"]
FOUND = [("7", None, None, None), ("T-9", None, None, None), (None, None, None, None), (None, "CAM_intel-2", None, None), (None, "cam_4", None, 900), (None, None, None, None), (None, None, "alpha", 7200), (None, "cam_3", "9", 30), (None, None, None, None), (None, "cctv_4", "b2", None)]
_part = lambda i: "[" + ", ".join("NULL" if f[i] is None else repr(f[i]) for f in FOUND) + f"][k % {len(FOUND)} + 1]"


@query("strg05_extraction", f"SELECT event_id, {_part(0)} AS track, {_part(1)} AS camera, {_part(2)} AS zone, {_part(3)} AS look_back FROM x")
def strg05(spark: S, d: str) -> DataFrame:
    q = one_of(QUESTIONS, F.col("k"))
    return observations(spark, d).select("event_id", text.track_named(q).alias("track"), text.camera_named(q).alias("camera"), text.zone_named(q).alias("zone"), text.look_back(q).alias("look_back"))


@query(
    "src12_camera_presets",
    "SELECT s_suppkey, s_name AS vendor, CASE WHEN s_suppkey % 3 = 0 THEN 'rtsp' ELSE 'http' END AS protocol, CASE WHEN s_suppkey % 2 = 0 THEN 8000 + s_nationkey ELSE 554 END AS default_port, 'tcp' AS transport, "
    "CASE WHEN s_suppkey % 3 = 0 THEN 'rtsp' ELSE 'http' END || '://10.0.0.' || s_nationkey || ':' || CASE WHEN s_suppkey % 2 = 0 THEN 8000 + s_nationkey ELSE 554 END || '/ch' || (s_suppkey % 4) AS uri FROM supplier WHERE s_suppkey % 5 <> 0",
    False,
)
def src12(spark: S, d: str) -> DataFrame:
    """Presets of configuration documents, one of each supplier, and the address that each one's template gives."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    template = F.when(s % 5 != 0, F.lit("{protocol}://10.0.0.{host}:{port}/ch{channel}"))
    preset = F.struct(F.col("s_name").alias("vendor"), F.concat(F.lit("M"), s).alias("model"), F.when(s % 3 != 0, "http").alias("protocol"), F.when(s % 2 == 0, 8000 + n).alias("default_port"), template.alias("uri_template"))
    documents = table(spark, d, "supplier").select(F.to_json(F.struct(F.array(preset).alias("presets"))).alias("value"))
    found = definitions.presets_of(documents).withColumn("s_suppkey", F.substr("model", F.lit(2)).cast("long"))
    own = found.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    uri = definitions.stream_uri(F.col("uri_template"), {"protocol": F.col("protocol"), "host": n, "port": F.col("default_port"), "channel": s % 4})
    return own.select("s_suppkey", "vendor", "protocol", "default_port", F.col("recommended_transport").alias("transport"), uri.alias("uri"))


_edges = " UNION ALL ".join(f"SELECT {i} AS edge, {a[0]} AS ax, {a[1]} AS ay, {b[0]} AS ex, {b[1]} AS ey" for i, (a, b) in enumerate(zip(SQUARE, [*SQUARE[1:], SQUARE[0]], strict=True)))


@query(
    "j09_closing_edges",
    f""", s AS ({_edges}), p AS (SELECT x.*, s.*, greatest(0.0, least(1.0, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))) AS t FROM x, s),
    q AS (SELECT *, ax + t * (ex - ax) - x AS tx, ay + t * (ey - ay) - y AS ty FROM p), r AS (SELECT *, sqrt(tx * tx + ty * ty) AS d FROM q),
    v AS (SELECT *, CASE WHEN d < 0.0001 THEN 0 ELSE round(d, 1) END AS distance, CASE WHEN d < 0.0001 THEN 0 ELSE round((vx * tx + vy * ty) / d * 30, 1) END AS speed FROM r),
    w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY edge) AS n FROM v WHERE sqrt(vx * vx + vy * vy) >= 0.5 AND distance <= 350 AND speed >= 25)
    SELECT event_id, 'square' AS area_id, edge, distance, speed AS closing_speed, round(distance / speed, 1) AS time_to_breach FROM w WHERE n = 1""",
)
def j09(spark: S, d: str) -> DataFrame:
    """The first edge of the zone on which each track closes in."""
    corners = [*SQUARE, SQUARE[0]]
    edges = (F.struct(F.lit("square").alias("area_id"), F.lit(i).alias("edge"), *(F.lit(float(v)).alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*a, *b), strict=True))) for i, (a, b) in enumerate(zip(corners, corners[1:], strict=False)))
    segments = spark.range(1).select(F.inline(F.array(*edges)))  # made by Spark, so that no Python runs in the executors
    return joins.closing_targets(observations(spark, d), segments)




#: Demanded directions by what they ask of a move, and whether the name itself is the answer.
DEMANDS = [("NORTH", "y2 < y", True), ("UP", "y2 < y", False), ("DOWN", "y2 > y", False), ("OUTWARD", "y2 > y", True), ("EAST", "x2 > x", True), ("LEFT", "x2 < x", False), (" west", "x2 < x", True), ("INBOUND", "crossing = 'inbound'", False), ("B_TO_A", "crossing = 'outbound'", False), ("ANY", "true", False)]
_asked = " ".join(f"WHEN {i} THEN {wish}" for i, (_, wish, _) in enumerate(DEMANDS))
_named = " ".join(f"WHEN {i} THEN '{name.strip().upper()}'" for i, (name, _, own) in enumerate(DEMANDS) if own)


@query(
    "geo07_demanded_direction",
    ", m AS (SELECT event_id, k, x, y, x + vx * 20 AS x2, y + vy * 20 AS y2 FROM x), o AS (" + crossing_sql("event_id, k, x, y, x2, y2") + f") SELECT event_id, CASE k % {len(DEMANDS)} {_named} ELSE crossing END AS crossing FROM o WHERE CASE k % {len(DEMANDS)} {_asked} END",
)
def geo07(spark: S, d: str) -> DataFrame:
    """Crossings of a wire that have the direction that each move is asked for, by any of its names."""
    wire = tuple(F.lit(v) for v in WIRE)
    x, y = F.col("x"), F.col("y")
    found = geo.crossing(x, y, x + F.col("vx") * 20, y + F.col("vy") * 20, wire, one_of([name for name, _, _ in DEMANDS], F.col("k")))
    return observations(spark, d).select("event_id", found.alias("crossing")).where("crossing IS NOT NULL")


@query("flt06_all_or_any", "SELECT event_id, value > 50 AND k > 10 AND user_id % 2 = 0 AS every, value > 90 OR k > 95 OR user_id = 3 AS some FROM x WHERE value IS NOT NULL")
def flt06(spark: S, d: str) -> DataFrame:
    v, k, u = F.col("value"), F.col("k"), F.col("user_id")
    return observations(spark, d).select("event_id", ev.all_of([v > 50, k > 10, u % 2 == 0]).alias("every"), ev.any_of([v > 90, k > 95, u == 3]).alias("some"))


@query("flt08_given_only", "SELECT 'none' AS asked, count(*) AS n FROM x UNION ALL SELECT 'type', count(*) FROM x WHERE event_type = 'view' UNION ALL SELECT 'both', count(*) FROM x WHERE event_type = 'view' AND user_id = 3")
def flt08(spark: S, d: str) -> DataFrame:
    """How many rows each call of one composed filter keeps: without, with one and with two of its arguments."""
    rows = table(spark, d, "events")
    asked = {"none": {}, "type": {"event_type": "view"}, "both": {"event_type": "view", "user_id": 3}}
    counts = [rows.where(ev.matching(**{"event_type": None, "user_id": None} | given)).agg(F.lit(name).alias("asked"), F.count("*").alias("n")) for name, given in asked.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("map02_metadata_merge", "SELECT event_id, CASE WHEN k % 3 = 0 THEN 'new' WHEN k % 3 = 1 THEN 'old' END AS a, CASE WHEN k % 3 <> 2 THEN 'kept' END AS b, CASE WHEN k % 3 = 0 THEN 'more' WHEN k % 3 = 2 THEN 'more' END AS c FROM x")
def map02(spark: S, d: str) -> DataFrame:
    """Old and new metadata merged one level deep: both, the old alone, the new alone."""
    k, lit = F.col("k") % 3, F.lit
    old = F.when(k != 2, F.create_map(lit("a"), lit("old"), lit("b"), lit("kept")))
    new = F.when(k == 0, F.create_map(lit("a"), lit("new"), lit("c"), lit("more"))).when(k == 2, F.create_map(lit("c"), lit("more")))
    m = F.col("m")
    return observations(spark, d).select("event_id", ev.merged_metadata(old, new).alias("m")).select("event_id", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


NOW = datetime(2024, 1, 15, 12, 0, tzinfo=timezone.utc)
RANGES = [("last 3 hours", "2024-01-15 09:00", "2024-01-15 12:00"), ("between 1 and 5 pm yesterday", "2024-01-14 13:00", "2024-01-14 17:00"), ("around 7:30 am", "2024-01-15 07:30", "2024-01-15 08:30"), ("yesterday evening", "2024-01-14 17:00", "2024-01-14 21:00"), ("last night", "2024-01-14 21:00", "2024-01-15 00:00"), ("yesterday", "2024-01-14", "2024-01-15"), ("from 22 to 2", "2024-01-15 22:00", "2024-01-16 02:00"), ("today", "2024-01-15", "2024-01-15 12:00")]


@query("dt01_time_ranges", " UNION ALL ".join(f"SELECT '{q}' AS question, count(*) AS n, min(event_id) AS first FROM x WHERE ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for q, a, b in RANGES))
def dt01(spark: S, d: str) -> DataFrame:
    """Events within the time that each question names; the names are read on the driver and become literals."""
    spans = [(q, time_span(q, NOW)) for q, _, _ in RANGES]
    rows = table(spark, d, "events")
    naive = lambda t: F.lit(t.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    within = [rows.where(F.col("ts").between(naive(s.start), naive(s.end))).agg(F.lit(q).alias("question"), F.count("*").alias("n"), F.min("event_id").alias("first")) for q, s in spans]
    out = within[0]
    for more in within[1:]:
        out = out.unionByName(more)
    return out


READINGS = [("12", None, "am", 0), ("12", "30", "pm", 12), ("1", "05", "p.m.", 13), ("11", None, "PM", 23), ("13", None, None, 13), ("0", "00", None, 0), ("13", None, "pm", None), ("7", "75", None, None), ("24", None, None, None)]


@query("dt02_hours", " UNION ALL ".join(f"SELECT {i} AS reading, count(*) AS n FROM x WHERE hour(ts) = {'NULL' if h is None else h}" for i, (_, _, _, h) in enumerate(READINGS)))
def dt02(spark: S, d: str) -> DataFrame:
    """Events in the hour that each reading of twelve or twenty-four hours means; none if there is no such time."""
    hours = [(i, None if (t := clock(h, m, half)) is None else t.hour) for i, (h, m, half, _) in enumerate(READINGS)]
    named = spark.createDataFrame(hours, "reading int, hour int")
    counts = table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return named.join(counts, "hour", "left").select("reading", F.coalesce("n", F.lit(0)).alias("n"))
