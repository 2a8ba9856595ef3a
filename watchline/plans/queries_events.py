"""Queries of the event store: scans, filters, order and pages, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchline.functions import scoring
from watchline.operators import events as ev
from watchline.operators import joins, reports
from watchline.plans.base import observations, query
from watchline.sources.tables import table

S = SparkSession


@query("src01_newest_events", "SELECT event_id, ts, user_id, event_type FROM x ORDER BY ts DESC, event_id DESC LIMIT 50")
def src01(spark: S, d: str) -> DataFrame:
    return ev.get_events(table(spark, d, "events"), "ts", "event_id", newest_first=True, limit=50).select("event_id", "ts", "user_id", "event_type")


@query("src02_after_cursor", "SELECT event_id, ts, event_type FROM x WHERE event_id > 500 ORDER BY ts, event_id LIMIT 100")
def src02(spark: S, d: str) -> DataFrame:
    return ev.get_events(table(spark, d, "events"), "ts", "event_id", after_seq=500).select("event_id", "ts", "event_type")


@query("src03_point_lookup", "SELECT event_id, user_id, value FROM x WHERE event_id = 7 OR upper(event_type || '-' || event_id) = 'CLICK-9'")
def src03(spark: S, d: str) -> DataFrame:
    display = F.upper(F.concat_ws("-", "event_type", F.col("event_id").cast("string")))
    return table(spark, d, "events").where((F.col("event_id") == 7) | (display == "CLICK-9")).select("event_id", "user_id", "value")


@query("src15_legacy_page", "SELECT event_id, user_id FROM x ORDER BY event_id LIMIT 100 OFFSET 200")
def src15(spark: S, d: str) -> DataFrame:
    return ev.page(table(spark, d, "events").select("event_id", "user_id"), ["event_id"], 200, 100)


@query("src16_sensor_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event_type FROM x GROUP BY user_id")
def src16(spark: S, d: str) -> DataFrame:
    return ev.last_by(table(spark, d, "events"), ["user_id"], "event_type", "ts", "event_id")


@query("src17_nearest_frame", "SELECT user_id, arg_min(event_id, (abs(k - 50), event_id)) AS nearest FROM x GROUP BY user_id")
def src17(spark: S, d: str) -> DataFrame:
    return observations(spark, d).groupBy("user_id").agg(F.min_by("event_id", F.struct(F.abs(F.col("k") - 50), F.col("event_id"))).alias("nearest"))


@query("snk03_reject_duplicates", "SELECT event_id, user_id FROM x WHERE event_id % 10 <> 0", True)
def snk03(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id")
    return ev.append_new(e.where("event_id % 10 = 0"), e.union(e), "event_id")


@query("snk04_export", "SELECT event_id, CAST(ts AS VARCHAR) AS ts_text, event_type FROM (SELECT * FROM x ORDER BY ts DESC, event_id DESC LIMIT 200) ORDER BY ts, event_id")
def snk04(spark: S, d: str) -> DataFrame:
    rows = ev.newest_in_order(table(spark, d, "events"), "ts", "event_id", 200)
    return rows.select("event_id", F.col("ts").cast("string").alias("ts_text"), "event_type")


@query("snk09_track_upsert", "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey", False)
def snk09(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    return ev.upserted(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "status")


@query("snk13_outbox_oldest", "SELECT event_id FROM x WHERE k % 2 = 0 ORDER BY ts, event_id LIMIT 50")
def snk13(spark: S, d: str) -> DataFrame:
    return observations(spark, d).where("k % 2 = 0").orderBy("ts", "event_id").limit(50).select("event_id")


@query("snk14_outbox_pending", "SELECT count(*) AS pending FROM x WHERE k % 2 = 0")
def snk14(spark: S, d: str) -> DataFrame:
    return observations(spark, d).where("k % 2 = 0").agg(F.count("*").alias("pending"))


@query("snk15_acknowledged", "SELECT a.event_id, max(b.ts) AS acknowledged_at, max(b.ts) IS NOT NULL AS is_acknowledged FROM x a LEFT JOIN x b ON b.event_type = 'view' AND b.user_id = a.user_id AND b.k = a.k WHERE a.event_type = 'error' GROUP BY a.event_id")
def snk15(spark: S, d: str) -> DataFrame:
    x = observations(spark, d).withColumn("alert", F.concat_ws("-", F.col("user_id").cast("string"), F.col("k").cast("string")))
    alerts = x.where("event_type = 'error'").select("event_id", "alert")
    acks = x.where("event_type = 'view'").select("alert", F.col("ts").alias("at"))
    return ev.acknowledged(alerts, acks, "alert", "at").drop("alert")


@query("snk16_cleared", "SELECT event_id, event_type FROM x WHERE upper(event_type) NOT IN ('ERROR', 'VIEW')")
def snk16(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").where(~F.upper("event_type").isin("ERROR", "VIEW")).select("event_id", "event_type")


@query("snk17_migrate_missing", "SELECT event_id, upper(event_type) AS kind FROM x WHERE event_id % 3 <> 0")
def snk17(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.join(e.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti").select("event_id", F.upper("event_type").alias("kind"))


@query("snk20_audit_log", "SELECT event_id FROM (SELECT * FROM (SELECT * FROM x ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE k > 30 ORDER BY ts DESC, event_id DESC LIMIT 50)")
def snk20(spark: S, d: str) -> DataFrame:
    newest = ev.get_events(observations(spark, d), "ts", "event_id", newest_first=True, limit=100)
    return ev.get_events(newest.where("k > 30"), "ts", "event_id", newest_first=True, limit=50).select("event_id")


@query("flt01_equality", "SELECT event_id FROM x WHERE event_type = 'click' AND user_id = 3")
def flt01(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").where(ev.matching(event_type="click", user_id=3)).select("event_id")


@query("flt02_since", "SELECT event_id, ts FROM x WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def flt02(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id", "ts")


@query("flt03_between", "SELECT event_id FROM x WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def flt03(spark: S, d: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return table(spark, d, "events").where(F.col("ts").between(at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00"))).select("event_id")


@query("flt04_in_list", "SELECT event_id FROM x WHERE event_type IN ('error', 'signup')")
def flt04(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type").isin("error", "signup")).select("event_id")


@query("flt05_nulls", "SELECT count(*) FILTER (WHERE nullif(k % 5, 0) IS NULL) AS missing, count(*) FILTER (WHERE nullif(k % 5, 0) IS NOT NULL) AS present FROM x")
def flt05(spark: S, d: str) -> DataFrame:
    v = F.nullif(F.col("k") % 5, F.lit(0))
    return observations(spark, d).agg(F.count_if(v.isNull()).alias("missing"), F.count_if(v.isNotNull()).alias("present"))


@query("flt07_contains", "SELECT doc_id FROM documents WHERE contains(text, 'tion')", False)
def flt07(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").contains("tion")).select("doc_id")


@query("flt09_limit_then_filter", "SELECT event_id, event_type FROM (SELECT * FROM x ORDER BY ts DESC, event_id DESC LIMIT 50) WHERE upper(event_type) = 'ERROR'")
def flt09(spark: S, d: str) -> DataFrame:
    return ev.limited_then_filtered(table(spark, d, "events"), "ts", "event_id", 50, "event_type", "error").select("event_id", "event_type")


@query("flt10_payload", "SELECT event_id, k FROM x WHERE k >= 90")
def flt10(spark: S, d: str) -> DataFrame:
    return observations(spark, d).where("k >= 90").select("event_id", "k")


@query("flt11_night", "SELECT event_id FROM x WHERE hour(ts) >= 22 OR hour(ts) < 5")
def flt11(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").where(scoring.is_night(F.col("ts"))).select("event_id")


@query("flt12_night_text", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'night|dark') OR doc_id % 50 = 0", False)
def flt12(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").rlike("night|dark") | (F.col("doc_id") % 50 == 0)).select("doc_id")


@query("flt14_class_floors", "SELECT event_id FROM x JOIN (VALUES ('click', 20.0), ('error', 60.0)) f(kind, floor) ON event_type = kind WHERE value >= floor")
def flt14(spark: S, d: str) -> DataFrame:
    floors = spark.createDataFrame([("click", 20.0), ("error", 60.0)], "event_type string, floor double")
    return table(spark, d, "events").join(F.broadcast(floors), "event_type").where("value >= floor").select("event_id")


@query("flt15_valid_box", "SELECT event_id FROM x WHERE x + vx > x AND y + vy > y")
def flt15(spark: S, d: str) -> DataFrame:
    return observations(spark, d).where("x + vx > x AND y + vy > y").select("event_id")


@query("flt17_unacknowledged", "SELECT event_id FROM x WHERE NOT coalesce(TRY_CAST(json_extract_string(props, '$.acknowledged') AS BOOLEAN), false)")
def flt17(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").where(~F.coalesce(F.get_json_object("props", "$.acknowledged").try_cast("boolean"), F.lit(False))).select("event_id")


@query("prj01_aliases", "SELECT event_id AS seq_id, user_id AS track_id, user_id AS global_person_id, k AS frame FROM x")
def prj01(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select(F.col("event_id").alias("seq_id"), F.col("user_id").alias("track_id"), F.col("user_id").alias("global_person_id"), F.col("k").alias("frame"))


@query("prj03_timeline_defaults", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) * 30 + 15 AS frame, (row_number() OVER (ORDER BY ts, event_id) - 1) * 5 AS offset_s FROM (SELECT * FROM x ORDER BY ts, event_id LIMIT 100)")
def prj03(spark: S, d: str) -> DataFrame:
    rows = ev.get_events(table(spark, d, "events"), "ts", "event_id", limit=100)
    # At most 100 rows are numbered in one partition.
    n = F.row_number().over(Window.orderBy("ts", "event_id")) - 1
    return rows.select("event_id", (n * 30 + 15).cast("long").alias("frame"), (n * 5).cast("long").alias("offset_s"))


@query("prj04_truthy", "SELECT event_id, coalesce(nullif(CASE WHEN k % 2 = 0 THEN '' ELSE event_type END, ''), 'none') AS label FROM x")
def prj04(spark: S, d: str) -> DataFrame:
    label = F.when(F.col("k") % 2 == 0, "").otherwise(F.col("event_type"))
    return observations(spark, d).select("event_id", ev.truthy(label, F.lit("none")).alias("label"))


@query("prj06_percent", "SELECT event_id, round(x / 1280 * 100, 2) AS cx, round(y / 720 * 100, 2) AS cy, x / 1280 * 100 > 50 AS is_breached FROM x")
def prj06(spark: S, d: str) -> DataFrame:
    cx = F.col("x") / 1280 * 100
    return observations(spark, d).select("event_id", F.round(cx, 2).alias("cx"), F.round(F.col("y") / 720 * 100, 2).alias("cy"), (cx > 50).alias("is_breached"))


@query("j01_migration_equal", "SELECT count(*) AS n, count(*) FILTER (WHERE a.value IS NOT DISTINCT FROM b.value) AS same FROM events a JOIN events b ON a.event_id = b.event_id", False)
def j01(spark: S, d: str) -> DataFrame:
    a = table(spark, d, "events").select("event_id", F.col("value").alias("a"))
    b = table(spark, d, "events").select("event_id", F.col("value").alias("b"))
    return a.join(b, "event_id").agg(F.count("*").alias("n"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


@query("j02_enrich", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", False)
def j02(spark: S, d: str) -> DataFrame:
    # Orders are counted before the join, so that it meets one row a customer.
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


ASOF_SQL = """, pairs AS (
    SELECT n.event_id AS entry_id, e.event_id AS exit_id, e.camera_id AS from_camera, n.camera_id AS to_camera, n.s - e.s AS delta_seconds,
      row_number() OVER (PARTITION BY n.event_id ORDER BY e.s DESC, e.event_id DESC) AS n
    FROM x n JOIN x e ON n.k % 10 = e.k % 10 AND e.camera_id <> n.camera_id AND n.s - e.s BETWEEN 0.5 AND 3600
    WHERE n.event_type = 'signup' AND e.event_type = 'error')
  SELECT entry_id, exit_id, from_camera, to_camera, round(delta_seconds, 3) AS delta_seconds,
    round(greatest(0.40, least(0.75, 1 - delta_seconds / 3600)), 3) AS confidence FROM pairs WHERE n = 1"""


@query("j06_asof_correlation", ASOF_SQL)
def j06(spark: S, d: str) -> DataFrame:
    x = observations(spark, d).withColumn("object_class", F.col("k") % 10)
    rows = joins.as_of_correlation(x.where("event_type = 'error'"), x.where("event_type = 'signup'"), most=3600.0)
    return rows.select("entry_id", "exit_id", "from_camera", "to_camera", F.round("delta_seconds", 3).alias("delta_seconds"), "confidence")


@query("j07_first_match", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS first_order FROM customer", False)
def j07(spark: S, d: str) -> DataFrame:
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
    return table(spark, d, "customer").select("c_custkey").join(first, "c_custkey", "left")


@query("j08_timeline_union", "SELECT o_orderkey AS id, 'incident' AS section, 1 AS n FROM orders UNION ALL SELECT l_orderkey, 'alert', count(*) FROM lineitem GROUP BY l_orderkey", False)
def j08(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("incident").alias("section"), F.lit(1).cast("long").alias("n"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    return o.unionByName(lines.select("id", F.lit("alert").alias("section"), "n"))


@query("j12_missing_ids", "SELECT count(*) AS missing FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", False)
def j12(spark: S, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").agg(F.count("*").alias("missing"))


@query("j16_ping_pong", "SELECT a.user_id AS a, b.user_id AS b, min(a.event_id) AS frame FROM x a JOIN x b ON a.user_id < b.user_id AND abs(a.event_id - b.event_id) < 30 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 100 GROUP BY a.user_id, b.user_id")
def j16(spark: S, d: str) -> DataFrame:
    return joins.ping_pong(observations(spark, d), "user_id", "event_id", "x", "y")


@query("j17_two_ids", "SELECT a.k AS k, a.camera_id AS camera_id, a.event_id AS a, b.event_id AS b FROM x a JOIN x b ON a.k = b.k AND a.camera_id = b.camera_id AND a.event_id < b.event_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 30")
def j17(spark: S, d: str) -> DataFrame:
    return joins.frame_pairs(observations(spark, d), ["k", "camera_id"], "event_id", "x", "y", 30.0).select("k", "camera_id", "a", "b")


@query("agg01_store_stats", "SELECT count(*) AS total_events, count(*) FILTER (WHERE event_type = 'error') AS total_alerts, count(DISTINCT camera_id) AS cameras FROM x")
def agg01(spark: S, d: str) -> DataFrame:
    return observations(spark, d).agg(F.count("*").alias("total_events"), F.count_if(F.col("event_type") == "error").alias("total_alerts"), F.countDistinct("camera_id").alias("cameras"))


@query("agg02_incident_rollup", "SELECT user_id, event_type, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM x GROUP BY user_id, event_type ORDER BY last_ts DESC, user_id, event_type LIMIT 100")
def agg02(spark: S, d: str) -> DataFrame:
    return ev.incident_rollup(table(spark, d, "events"), ["user_id", "event_type"], "ts", 100)


@query("agg03_transitions", "SELECT f, t, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT camera_id AS t, lag(camera_id) OVER (PARTITION BY k ORDER BY ts, event_id) AS f, value FROM x) WHERE f <> t GROUP BY f, t")
def agg03(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    rows = observations(spark, d).select(F.lag("camera_id").over(w).alias("f"), F.col("camera_id").alias("t"), "value")
    return rows.where("f <> t").groupBy("f", "t").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("agg04_types_by_track", "SELECT event_type, count(*) AS n FROM (SELECT * FROM x WHERE user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 100) GROUP BY event_type")
def agg04(spark: S, d: str) -> DataFrame:
    return ev.get_events(table(spark, d, "events"), "ts", "event_id", newest_first=True, limit=100, user_id=3).groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg05_types_by_window", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM x GROUP BY 1, 2")
def agg05(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("agg06_max_dwell", "SELECT user_id, max(value) AS max_dwell, count(*) FILTER (WHERE event_type = 'view') > 0 AS loitered FROM x GROUP BY user_id")
def agg06(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("max_dwell"), (F.count_if(F.col("event_type") == "view") > 0).alias("loitered"))


@query("agg07_distinct_tracks", "SELECT camera_id, count(DISTINCT user_id) AS tracks FROM x GROUP BY camera_id")
def agg07(spark: S, d: str) -> DataFrame:
    return observations(spark, d).groupBy("camera_id").agg(F.countDistinct("user_id").alias("tracks"))


@query("agg08_last_class", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event_type FROM x WHERE k % 2 = 0 GROUP BY user_id")
def agg08(spark: S, d: str) -> DataFrame:
    return ev.last_by(observations(spark, d).where("k % 2 = 0"), ["user_id"], "event_type", "ts", "event_id")


@query("agg09_busiest_camera", "SELECT camera_id, count(DISTINCT user_id) AS tracks FROM x GROUP BY camera_id ORDER BY tracks DESC, camera_id LIMIT 1")
def agg09(spark: S, d: str) -> DataFrame:
    return observations(spark, d).groupBy("camera_id").agg(F.countDistinct("user_id").alias("tracks")).orderBy(F.desc("tracks"), "camera_id").limit(1)


@query(
    "agg11_heatmap",
    """, cells AS (SELECT CAST(floor(x / 80) AS BIGINT) AS cx, CAST(floor(y / 45) AS BIGINT) AS cy, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT a.range AS cx, b.range AS cy, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT max(n) FROM cells), 3) AS heat, coalesce(n, 0) / (SELECT max(n) FROM cells) >= 0.6 AS hotspot
    FROM range(16) a CROSS JOIN range(16) b LEFT JOIN cells ON cx = a.range AND cy = b.range""",
)
def agg11(spark: S, d: str) -> DataFrame:
    return reports.heatmap(observations(spark, d), "x", "y", 1280.0, 720.0)


@query(
    "agg12_dossier",
    """SELECT user_id, count(*) AS n_events, round(max(s) - min(s), 3) AS duration, round(avg(value), 6) AS mean_speed,
      round(sqrt(pow(arg_max(x, (ts, event_id)) - arg_min(x, (ts, event_id)), 2) + pow(arg_max(y, (ts, event_id)) - arg_min(y, (ts, event_id)), 2)), 1) AS displacement
    FROM x GROUP BY user_id""",
)
def agg12(spark: S, d: str) -> DataFrame:
    return reports.dossiers(observations(spark, d), "user_id", "ts", "event_id", "value")


@query("agg13_fleet", "SELECT camera_id, sum(k) AS frames, round(avg(value), 6) AS mean_fps, count(*) AS n FROM x GROUP BY camera_id")
def agg13(spark: S, d: str) -> DataFrame:
    return observations(spark, d).groupBy("camera_id").agg(F.sum("k").alias("frames"), F.round(F.avg("value"), 6).alias("mean_fps"), F.count("*").alias("n"))


@query("agg14_coverage", "SELECT online, CASE WHEN online >= 90 THEN 'GRADE_A_COMBAT_READY' WHEN online >= 70 THEN 'GRADE_B_DEGRADED' ELSE 'GRADE_C_VULNERABLE' END AS grade FROM (SELECT round(100.0 * avg(CASE WHEN value > 20 THEN 1 ELSE 0 END), 1) AS online FROM x)")
def agg14(spark: S, d: str) -> DataFrame:
    totals = table(spark, d, "events").agg(F.count_if(F.col("value") > 20).alias("active"), F.count("*").alias("total"))
    return totals.select(scoring.coverage_grade(F.col("active"), F.col("total")).alias("c")).select(F.col("c.percent").alias("online"), "c.grade")


@query("agg21_mean_embedding", "SELECT label, i, round(avg(embedding[i]), 4) AS v FROM embeddings, range(1, 65) r(i) GROUP BY label, i", False)
def agg21(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.avg("v"), 4).alias("v"))


@query("agg22_index_percentiles", "SELECT event_type, l[len(l) // 2 + 1] AS p50, l[CAST(floor(0.95 * len(l)) AS BIGINT) + 1] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS l FROM x GROUP BY event_type)")
def agg22(spark: S, d: str) -> DataFrame:
    return reports.index_percentiles(table(spark, d, "events"), ["event_type"], "value", "event_id")


@query("agg23_percentile", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM x GROUP BY event_type")
def agg23(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("agg25_duplicates", "SELECT user_id, k, count(*) AS n FROM x GROUP BY user_id, k HAVING count(*) > 1")
def agg25(spark: S, d: str) -> DataFrame:
    return observations(spark, d).groupBy("user_id", "k").agg(F.count("*").alias("n")).where("n > 1")


@query("agg26_buckets", "SELECT CASE WHEN value IS NULL THEN 'null' WHEN value < 10 THEN '0' WHEN value < 50 THEN '10' WHEN value < 100 THEN '50' ELSE '100' END AS bucket, count(*) AS n FROM x GROUP BY 1")
def agg26(spark: S, d: str) -> DataFrame:
    v = F.col("value")
    bucket = F.when(v.isNull(), "null").when(v < 10, "0").when(v < 50, "10").when(v < 100, "50").otherwise("100")
    return table(spark, d, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("agg27_by_day", "SELECT substring(CAST(ts AS VARCHAR), 1, 10) AS day, count(*) AS n FROM x GROUP BY 1")
def agg27(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.substring(F.col("ts").cast("string"), 1, 10).alias("day")).agg(F.count("*").alias("n"))


@query("agg28_null_profile", "SELECT count(*) FILTER (WHERE event_type IS NULL) AS event_type_nulls, count(*) FILTER (WHERE value IS NULL) AS value_nulls, count(*) FILTER (WHERE props IS NULL) AS props_nulls FROM x")
def agg28(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").agg(*(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in ("event_type", "value", "props")))


@query("agg29_json_keys", "SELECT event_type, unnest(json_keys(props)) AS key, count(*) AS n FROM x GROUP BY 1, 2")
def agg29(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query("agg30_valid_json", "SELECT count(*) FILTER (WHERE json_valid(props)) AS valid FROM x")
def agg30(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"))


@query("agg33_display_ids", "SELECT user_id, 'GLOBAL-PERSON-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS display_id FROM (SELECT user_id, row_number() OVER (ORDER BY min(ts), user_id) AS n FROM x GROUP BY user_id)")
def agg33(spark: S, d: str) -> DataFrame:
    first = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    return reports.display_ids(first, "first_seen", "user_id", "GLOBAL-PERSON-").select("user_id", "display_id")


@query("agg34_lifespans", "SELECT user_id, count(*) AS sightings, min(event_id) AS first_frame, max(event_id) AS last_frame, coalesce(max(gap), 0) AS max_gap, round(avg(value), 6) AS mean_confidence FROM (SELECT *, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM x) GROUP BY user_id")
def agg34(spark: S, d: str) -> DataFrame:
    return reports.lifespans(table(spark, d, "events"), "user_id", "event_id", "value")


@query(
    "agg35_churn",
    """, f AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM x),
    d AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev FROM (SELECT DISTINCT day FROM f))
    SELECT d.day AS day, count(*) FILTER (WHERE p.user_id IS NULL) AS n_new, count(*) FILTER (WHERE p.user_id IS NOT NULL) AS n_kept
    FROM d JOIN f ON f.day = d.day LEFT JOIN f p ON p.day = d.prev AND p.user_id = f.user_id GROUP BY d.day""",
)
def agg35(spark: S, d: str) -> DataFrame:
    return reports.churn(table(spark, d, "events").withColumn("day", F.to_date("ts")), "day", "user_id", F.trunc("day", "month"))


@query("agg37_stage_latency", "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM x GROUP BY event_type")
def agg37(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.99), 6).alias("p99"), F.max("value").alias("most"))


@query("agg38_detection_coverage", "SELECT round(avg(CASE WHEN n > 3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT user_id, count(*) AS n FROM x GROUP BY user_id)")
def agg38(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).agg(F.round(F.avg(F.when(F.col("n") > 3, 1.0).otherwise(0.0)), 6).alias("share"))


def track_window() -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("win01_previous", "SELECT event_id, lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS px FROM x")
def win01(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", F.lag("x").over(track_window()).alias("px"))


@query("win02_hop_end", "SELECT event_id, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS hop_end FROM x")
def win02(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.coalesce(F.lead("ts").over(track_window()), "ts").alias("hop_end"))


@query("win03_hop_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hop FROM x")
def win03(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.row_number().over(track_window()).cast("long").alias("hop"))


@query("win04_displacement", "SELECT event_id, round(sqrt(pow(x - first_value(x) OVER w, 2) + pow(y - first_value(y) OVER w, 2)), 4) AS moved FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def win04(spark: S, d: str) -> DataFrame:
    w = track_window().rowsBetween(-4, 0)
    moved = F.hypot(F.col("x") - F.first("x").over(w), F.col("y") - F.first("y").over(w))
    return observations(spark, d).select("event_id", F.round(moved, 4).alias("moved"))


@query("win05_influx_slope", "SELECT event_id, round(regr_slope(CAST(k AS DOUBLE), s - 1704067200) OVER w, 6) AS slope, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)")
def win05(spark: S, d: str) -> DataFrame:
    w = track_window().rowsBetween(-14, 0)
    slope = F.regr_slope(F.col("k").cast("double"), F.col("s") - 1704067200).over(w)
    return observations(spark, d).select("event_id", F.round(slope, 6).alias("slope"), F.count("*").over(w).alias("n"))


@query("win06_latency_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 6) AS mean FROM x")
def win06(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(track_window().rowsBetween(-14, 0)), 6).alias("mean"))


@query("win07_last_ten", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM x) WHERE n <= 10")
def win07(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("n")).where("n <= 10").select("event_id")


@query("win08_first_and_last", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM x GROUP BY user_id")
def win08(spark: S, d: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", order).alias("first_event"), F.max_by("event_id", order).alias("last_event"))


@query("win10_reentries", "SELECT event_id, row_number() OVER (PARTITION BY user_id, camera_id ORDER BY ts, event_id) AS entry FROM x WHERE event_type = 'view'")
def win10(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "camera_id").orderBy("ts", "event_id")
    return observations(spark, d).where("event_type = 'view'").select("event_id", F.row_number().over(w).cast("long").alias("entry"))


@query("win11_id_switches", "SELECT user_id, count(*) FILTER (WHERE kind <> prev) AS switches FROM (SELECT user_id, event_type AS kind, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM x) GROUP BY user_id")
def win11(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.col("event_type") != F.lag("event_type").over(track_window())).alias("switch"))
    return rows.groupBy("user_id").agg(F.count_if("switch").alias("switches"))


@query("win12_gaps", "SELECT user_id, event_id - gap AS before, event_id AS after, gap FROM (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM x) WHERE gap > 300")
def win12(spark: S, d: str) -> DataFrame:
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select("user_id", "event_id", gap.alias("gap")).where("gap > 300")
    return rows.select("user_id", (F.col("event_id") - F.col("gap")).alias("before"), F.col("event_id").alias("after"), "gap")


@query("srt02_newest_chronological", "SELECT event_id, ts FROM (SELECT * FROM x ORDER BY ts DESC, event_id DESC LIMIT 30) ORDER BY ts, event_id")
def srt02(spark: S, d: str) -> DataFrame:
    return ev.newest_in_order(table(spark, d, "events"), "ts", "event_id", 30).select("event_id", "ts")


@query("srt03_top_confidence", "SELECT event_id, value FROM x ORDER BY value DESC, event_id LIMIT 10")
def srt03(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "value")


@query("srt05_top_per_frame", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY value DESC, event_id) AS n FROM x) WHERE n <= 3")
def srt05(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("k").orderBy(F.desc("value"), "event_id")
    return observations(spark, d).select("event_id", F.row_number().over(w).alias("n")).where("n <= 3").select("event_id")


@query("srt07_sample")
def srt07(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.rand(7)).limit(10).select("event_id")


@query("set02_ordered_reasons", "SELECT user_id, string_agg(event_type, ',' ORDER BY first_seen) AS reasons FROM (SELECT user_id, event_type, min(event_id) AS first_seen FROM x GROUP BY user_id, event_type) GROUP BY user_id")
def set02(spark: S, d: str) -> DataFrame:
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda r: r["event_type"]), ",").alias("reasons"))


@query("set03_visited", "SELECT user_id, string_agg(DISTINCT CAST(camera_id AS VARCHAR), ',' ORDER BY CAST(camera_id AS VARCHAR)) AS cameras FROM (SELECT user_id, k % 7 AS camera_id FROM x) GROUP BY user_id")
def set03(spark: S, d: str) -> DataFrame:
    return observations(spark, d).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set((F.col("k") % 7).cast("string"))), ",").alias("cameras"))


@query("set04_difference", "SELECT user_id FROM x WHERE event_type = 'view' EXCEPT SELECT user_id FROM x WHERE event_type = 'error' AND k > 90")
def set04(spark: S, d: str) -> DataFrame:
    x = observations(spark, d)
    return x.where("event_type = 'view'").select("user_id").subtract(x.where("event_type = 'error' AND k > 90").select("user_id"))


@query("set05_distinct", "SELECT DISTINCT event_type, camera_id FROM x")
def set05(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_type", "camera_id").distinct()
