"""Queries of scalar functions: space, movement, scores, text, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchline.functions import geo, kinematics, scoring, text
from watchline.operators import joins, reports
from watchline.operators import folds
from watchline.plans.base import observations, query
from watchline.sources.tables import table

S = SparkSession
SQUARE = [(200.0, 100.0), (900.0, 150.0), (800.0, 600.0), (300.0, 650.0)]
WIRE = (100.0, 200.0, 1100.0, 500.0)


def c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def inside_sql(vertices: list[tuple[float, float]]) -> str:
    """SQL of zone containment of (x, y): how many edges a ray to the right crosses is odd."""
    hits = []
    for (ax, ay), (bx, by) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        on = f"y > {min(ay, by)} AND y <= {max(ay, by)} AND x <= {max(ax, bx)}"
        cut = "" if ax == bx else f" AND x <= (y - {ay}) * ({bx} - {ax}) / ({by} - {ay}) + {ax}"
        hits.append(f"CASE WHEN {on}{cut} THEN 1 ELSE 0 END" if ay != by else "0")
    return f"(({' + '.join(hits)}) % 2 = 1)"


@query("geo01_zone_contains", f"SELECT event_id, {inside_sql(SQUARE)} AS inside FROM x")
def geo01(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", geo.zone_contains(*c("x", "y"), geo.polygon(SQUARE)).alias("inside"))


def strict_sql(vertices: list[tuple[float, float]]) -> str:
    hits = [
        f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < (y - {ay}) * ({bx} - {ax}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END"
        for (ax, ay), (bx, by) in zip(vertices, [*vertices[1:], vertices[0]], strict=True)
    ]
    return f"(({' + '.join(hits)}) % 2 = 1)"


@query("geo02_polygon_contains", f"SELECT event_id, {strict_sql(SQUARE)} AS inside FROM x")
def geo02(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", geo.polygon_contains(*c("x", "y"), geo.polygon(SQUARE)).alias("inside"))


@query("geo03_bounds", "SELECT camera_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM x GROUP BY camera_id")
def geo03(spark: S, d: str) -> DataFrame:
    shape = observations(spark, d).groupBy("camera_id").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    return shape.select("camera_id", geo.polygon_bounds(F.col("p")).alias("b")).select("camera_id", "b.*")


@query("geo05_valid_polygons", "SELECT user_id, count(*) FILTER (WHERE k % 3 <> 0) AS vertices FROM x GROUP BY user_id HAVING count(*) FILTER (WHERE k % 3 <> 0) >= 3")
def geo05(spark: S, d: str) -> DataFrame:
    p = F.struct(F.when(F.col("k") % 3 != 0, F.col("x")).alias("x"), F.col("y"))
    shapes = observations(spark, d).groupBy("user_id").agg(F.collect_list(p).alias("p")).withColumn("p", geo.normalized_polygon(F.col("p")))
    return shapes.where("p IS NOT NULL").select("user_id", F.size("p").cast("long").alias("vertices"))


def side_sql(ax: object, ay: object, bx: object, by: object, px: object, py: object) -> str:
    return f"(({py} - {ay}) * ({bx} - {ax}) - ({by} - {ay}) * ({px} - {ax}))"


_d = [side_sql(*WIRE, "x", "y"), side_sql(*WIRE, "x2", "y2"), side_sql("x", "y", "x2", "y2", *WIRE[:2]), side_sql("x", "y", "x2", "y2", *WIRE[2:])]


def crossing_sql(columns: str) -> str:
    """SQL of the crossings of WIRE by moves m from (x, y) to (x2, y2)."""
    return f"""SELECT {columns}, CASE WHEN {_d[0]} > 0 THEN 'inbound' ELSE 'outbound' END AS crossing FROM m
    WHERE sign({_d[0]}) * sign({_d[1]}) < 0 AND sign({_d[2]}) * sign({_d[3]}) < 0 AND sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) >= 2.5
      AND NOT (abs(x) <= 1 AND abs(x2) <= 1 AND abs(y) <= 1 AND abs(y2) <= 1)"""


@query("geo06_crossing", ", m AS (SELECT event_id, x, y, x + vx * 20 AS x2, y + vy * 20 AS y2 FROM x) " + crossing_sql("event_id"))
def geo06(spark: S, d: str) -> DataFrame:
    wire = tuple(F.lit(v) for v in WIRE)
    found = geo.crossing(*c("x", "y"), F.col("x") + F.col("vx") * 20, F.col("y") + F.col("vy") * 20, wire, F.lit("BIDIRECTIONAL"))
    return observations(spark, d).select("event_id", found.alias("crossing")).where("crossing IS NOT NULL")


@query("geo08_iou", "SELECT event_id, round(greatest(0, least(x + 100, 700) - greatest(x, 500)) * greatest(0, least(y + 100, 450) - greatest(y, 250)) / (10000 + 40000 - greatest(0, least(x + 100, 700) - greatest(x, 500)) * greatest(0, least(y + 100, 450) - greatest(y, 250))), 6) AS iou FROM x")
def geo08(spark: S, d: str) -> DataFrame:
    fixed = tuple(F.lit(v) for v in (500.0, 250.0, 700.0, 450.0))
    return observations(spark, d).select("event_id", F.round(geo.iou((F.col("x"), F.col("y"), F.col("x") + 100, F.col("y") + 100), fixed), 6).alias("iou"))


@query("geo10_box", "SELECT event_id, vx + 50 AS width, vy + 40 AS height, (vx + 50) * (vy + 40) AS area, (x + x + vx + 50) / 2 AS cx FROM x")
def geo10(spark: S, d: str) -> DataFrame:
    b = geo.box(F.col("x"), F.col("y"), F.col("x") + F.col("vx") + 50, F.col("y") + F.col("vy") + 40)
    return observations(spark, d).select("event_id", b.alias("b")).select("event_id", "b.width", "b.height", "b.area", "b.cx")


@query("geo11_centroid", "SELECT camera_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM x GROUP BY camera_id")
def geo11(spark: S, d: str) -> DataFrame:
    shape = observations(spark, d).groupBy("camera_id").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    return shape.select("camera_id", geo.centroid(F.col("p")).alias("m")).select("camera_id", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"))


CLOSING_SQL = """, t AS (SELECT *, greatest(0.0, least(1.0, (x - 100) / 800.0)) AS t FROM x),
  n AS (SELECT *, 100 + t * 800 - x AS tx, 400 - y AS ty FROM t),
  c AS (SELECT *, sqrt(tx * tx + ty * ty) AS dist FROM n),
  g AS (SELECT event_id, vx, vy, CASE WHEN dist < 1e-4 THEN 0.0 ELSE round(dist, 1) END AS distance,
    CASE WHEN dist < 1e-4 THEN 0.0 ELSE round((vx * tx + vy * ty) / dist * 30, 1) END AS speed FROM c)
"""


@query("geo12_closing", CLOSING_SQL + "SELECT event_id, distance, speed FROM g")
def geo12(spark: S, d: str) -> DataFrame:
    segment = tuple(F.lit(v) for v in (100.0, 400.0, 900.0, 400.0))
    return observations(spark, d).select("event_id", geo.closing(*c("x", "y", "vx", "vy"), segment).alias("c")).select("event_id", "c.distance", "c.speed")


@query("geo13_time_to_breach", CLOSING_SQL + "SELECT event_id, 'wire' AS area_id, distance, speed AS closing_speed, round(distance / speed, 1) AS time_to_breach FROM g WHERE distance <= 350 AND speed >= 25 AND sqrt(vx * vx + vy * vy) >= 0.5")
def geo13(spark: S, d: str) -> DataFrame:
    segments = spark.createDataFrame([("wire", 0, 100.0, 400.0, 900.0, 400.0)], "area_id string, edge int, ax double, ay double, bx double, by double")
    return joins.closing_targets(observations(spark, d), segments).drop("edge")


@query("geo14_cosine", "SELECT event_id, round(CASE WHEN vx = 0 AND vy = 0 THEN 0.0 ELSE (vx * 3 + vy * 4) / (sqrt(vx * vx + vy * vy) * 5) END, 6) AS cosine FROM x")
def geo14(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", F.round(geo.cosine_2d(*c("vx", "vy"), F.lit(3.0), F.lit(4.0)), 6).alias("cosine"))


@query("geo15_embedding_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding, b.embedding), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.label", False)
def geo15(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    anchor = e.select(F.col("vec_id").alias("label"), F.col("embedding").alias("anchor"))
    return e.join(anchor, "label").select("vec_id", F.round(geo.cosine(F.col("embedding"), F.col("anchor")), 4).alias("cosine"))


@query("kin02_cardinal", "SELECT event_id, ['E','SE','S','SW','W','NW','N','NE'][CAST(floor(((k * 7) % 360 + 22.5) / 45) AS BIGINT) % 8 + 1] AS heading FROM x")
def kin02(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", kinematics.cardinal((F.col("k") * 7).cast("double")).alias("heading"))


@query("kin03_speed_label", "SELECT event_id, CASE WHEN value < 2 THEN 'Stationary' WHEN value > 120 THEN 'Fast Moving (Rel)' WHEN value > 40 THEN 'Moderate (Rel)' ELSE 'Slow Moving (Rel)' END AS label FROM x")
def kin03(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", kinematics.speed_label(F.col("value"), F.lit(False)).alias("label"))


@query(
    "kin04_moves_towards",
    """SELECT event_id, sqrt(pow(640 - x, 2) + pow(360 - y, 2)) < 5 OR
      abs((((degrees(atan2(360 - y, 640 - x)) - k * 3 + 180) % 360) + 360) % 360 - 180) <= 50 AS towards FROM x""",
)
def kin04(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", kinematics.moves_towards(*c("x", "y"), (F.col("k") * 3).cast("double"), F.lit(640.0), F.lit(360.0)).alias("towards"))


def trajectories(spark: S, d: str) -> DataFrame:
    """The last 50 positions of each track, oldest first."""
    last = folds.last_rows(observations(spark, d), ["user_id"], ["ts", "event_id"], 50)
    rows = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "x", "y"))).alias("p"))
    return rows.select("user_id", F.transform("p", lambda p: geo.point(p["x"], p["y"])).alias("p"))


PLACES_SQL = ", o AS (SELECT user_id, x, y, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM x)"
_at = "max({0}) FILTER (WHERE place = {1})"
_turn = "abs((({b} - {a} + 180) % 360 + 360) % 360 - 180)"
_angle = "((degrees(atan2({0}, {1})) % 360) + 360) % 360"


@query(
    "kin05_abrupt_turn",
    PLACES_SQL
    + f""", w AS (SELECT user_id, {_at.format('x', 5)} - {_at.format('x', 8)} AS ax, {_at.format('y', 5)} - {_at.format('y', 8)} AS ay,
      {_at.format('x', 1)} - {_at.format('x', 4)} AS bx, {_at.format('y', 1)} - {_at.format('y', 4)} AS "by" FROM o GROUP BY user_id),
    h AS (SELECT *, round({_angle.format('ay', 'ax')}, 1) AS a, round({_angle.format('"by"', 'bx')}, 1) AS b FROM w)
    SELECT user_id, coalesce(sqrt(ax * ax + ay * ay) >= 6 AND sqrt(bx * bx + "by" * "by") >= 6 AND {_turn.format(a='a', b='b')} >= 90, false) AS abrupt FROM h""",
)
def kin05(spark: S, d: str) -> DataFrame:
    return trajectories(spark, d).select("user_id", kinematics.turns_abruptly(F.col("p")).alias("abrupt"))


@query(
    "kin06_oscillation",
    PLACES_SQL
    + f""", c AS (SELECT *, least(count(*) OVER (PARTITION BY user_id), 50) AS n FROM o), p AS (SELECT user_id, n, x, y, n - place AS i FROM c WHERE place <= 50),
    e AS (SELECT user_id, n, i, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WHERE i % 4 = 0 WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    h AS (SELECT user_id, i, {_angle.format('dy', 'dx')} AS a FROM e WHERE sqrt(dx * dx + dy * dy) > 2),
    t AS (SELECT user_id, a, lag(a) OVER (PARTITION BY user_id ORDER BY i) AS b FROM h),
    k AS (SELECT user_id, count(*) AS moves, count(*) FILTER (WHERE {_turn.format(a='b', b='a')} > 110) AS turns FROM t GROUP BY user_id)
    SELECT p.user_id, coalesce(max(p.n) >= 16 AND max(k.moves) >= 3 AND max(k.turns) >= 2, false) AS oscillates FROM p LEFT JOIN k ON k.user_id = p.user_id GROUP BY p.user_id""",
)
def kin06(spark: S, d: str) -> DataFrame:
    return trajectories(spark, d).select("user_id", kinematics.oscillates(F.col("p")).alias("oscillates"))


@query("kin08_displacement", "SELECT user_id, round(sqrt(pow(arg_max(x, (ts, event_id)) - arg_min(x, (ts, event_id)), 2) + pow(arg_max(y, (ts, event_id)) - arg_min(y, (ts, event_id)), 2)), 2) AS moved FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM x) WHERE n <= 50 GROUP BY user_id")
def kin08(spark: S, d: str) -> DataFrame:
    return trajectories(spark, d).select("user_id", F.round(kinematics.displacement(F.col("p")), 2).alias("moved"))


@query(
    "scr01_threat_score",
    """, f AS (SELECT event_id, k % 2 = 0 AS a, k % 3 = 0 AS b, k % 5 = 0 AS c, hour(ts) >= 22 OR hour(ts) < 5 AS n FROM x),
    t AS (SELECT event_id, CAST(least(100, CASE WHEN a THEN 35 ELSE 0 END + CASE WHEN b THEN 30 ELSE 0 END + CASE WHEN c THEN 15 ELSE 0 END + CASE WHEN n THEN 15 ELSE 0 END) AS DOUBLE) AS score FROM f)
    SELECT event_id, score, CASE WHEN score >= 65 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 30 THEN 'RESTRICTED' WHEN score > 0 THEN 'LOW' ELSE 'NORMAL' END AS level FROM t""",
)
def scr01(spark: S, d: str) -> DataFrame:
    k = F.col("k")
    flags = {"restricted_intrusion": k % 2 == 0, "tripwire_breach": k % 3 == 0, "loitering": k % 5 == 0, "night_movement": scoring.is_night(F.col("ts"))}
    return observations(spark, d).select("event_id", scoring.threat(flags).alias("t")).select("event_id", "t.score", "t.level")


@query("scr03_incident_severity", "SELECT event_id, CASE WHEN value >= 85 THEN 'CRITICAL' WHEN value >= 70 THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM' WHEN value >= 30 THEN 'LOW' ELSE 'INFO' END AS severity FROM x")
def scr03(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scoring.incident_severity(F.col("value")).alias("severity"))


@query("scr04_alert_rule", "SELECT event_id FROM x WHERE value >= 30 OR regexp_matches(lower(event_type), 'intrusion|breach|weapon')")
def scr04(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").where(scoring.raises_alert(F.col("value"), F.col("event_type"))).select("event_id")


@query(
    "scr06_plausibility",
    """, m AS (SELECT event_id, camera_id AS f, k % 8 AS t, value AS e FROM x)
    SELECT event_id, CASE WHEN f = t THEN 1.0 WHEN f = 0 AND t = 1 THEN CASE WHEN e < 5 THEN 0.1 WHEN e > 120 THEN 0.4 ELSE round(least(1.0, greatest(0.5, 1 - abs(e - 30) / (60 + 1e-6)) * 0.9), 2) END
      WHEN f = 0 THEN CASE WHEN e > 300 THEN 0.25 ELSE 0.05 END ELSE 0.7 END AS score,
      NOT ((f = 0 AND t > 1 AND e <= 300) OR (f = 0 AND t = 1 AND e < 5)) AS plausible FROM m""",
)
def scr06(spark: S, d: str) -> DataFrame:
    edges = spark.createDataFrame([(0, 1, 10.0, 60.0, 30.0, 0.9)], "from_camera long, to_camera long, min_s double, max_s double, avg_s double, weight double")
    moves = observations(spark, d).select("event_id", F.col("camera_id").alias("from_camera"), (F.col("k") % 8).alias("to_camera"), F.col("value").alias("elapsed"))
    return joins.plausible_transitions(moves, edges).select("event_id", "score", "plausible")


@query("scr08_frame_quality", "SELECT event_id, round(0.45 * (k / 100.0) + 0.35 * (x / 1280) + 0.20 * (y / 720), 6) AS quality FROM x")
def scr08(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", F.round(scoring.frame_quality(F.col("k") / 100, F.col("x") / 1280, F.col("y") / 720), 6).alias("quality"))


@query("scr10_optical_status", "SELECT event_id, CASE WHEN k = 0 THEN 'FROZEN' WHEN value >= 100 THEN 'GLARE' WHEN k >= 75 AND x < 200 THEN 'DARK' WHEN y < 100 THEN 'BLURRED' ELSE 'CLEAR' END AS status FROM x")
def scr10(spark: S, d: str) -> DataFrame:
    status = scoring.optical_status(F.col("k") == 0, F.col("value") * 0.35, F.col("k"), F.col("x") / 10, F.col("y") * 0.3)
    return observations(spark, d).select("event_id", status.alias("status"))


@query("strg01_plate", "SELECT p_partkey, upper(replace(trim(p_name), ' ', '')) AS plate FROM part", False)
def strg01(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.plate(F.col("p_name")).alias("plate"))


@query("strg04_alphanumerics", "SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS brand FROM part", False)
def strg04(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.letters_and_digits(F.col("p_brand")).alias("brand"))


@query("strg06_entity_id", "SELECT user_id, 'GLOBAL-PERSON-' || CASE WHEN length(CAST(user_id AS VARCHAR)) < 3 THEN lpad(CAST(user_id AS VARCHAR), 3, '0') ELSE CAST(user_id AS VARCHAR) END AS entity FROM x GROUP BY user_id")
def strg06(spark: S, d: str) -> DataFrame:
    ids = table(spark, d, "events").select("user_id").distinct()
    return ids.select("user_id", text.entity_id(F.concat(F.lit("person-"), F.col("user_id").cast("string"))).alias("entity"))


@query("strg08_masked", "SELECT event_id, 'rtsp://***:***@cam' || camera_id || '/live' AS url FROM x")
def strg08(spark: S, d: str) -> DataFrame:
    url = F.concat(F.lit("rtsp://user:pass@cam"), F.col("camera_id").cast("string"), F.lit("/live"))
    return observations(spark, d).select("event_id", text.masked_credentials(url).alias("url"))


@query("dt03_iso", "SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM x")
def dt03(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.iso_time(F.col("ts")).alias("iso"))


@query("dt04_duration", "SELECT user_id, round(max(s) - min(s), 3) AS duration FROM x GROUP BY user_id")
def dt04(spark: S, d: str) -> DataFrame:
    return observations(spark, d).groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), F.max("s") - F.min("s")), 3).alias("duration"))


HASH_SQL = "sha256(concat(CAST(event_id AS VARCHAR), '|', event_type, '|', CAST(user_id AS VARCHAR), '|', coalesce(CAST(nullif(k % 4, 0) AS VARCHAR), '')))"


def event_hash() -> Column:
    return reports.event_hash(F.col("event_id"), F.col("event_type"), F.col("user_id"), F.nullif(F.col("k") % 4, F.lit(0)))


@query("hsh01_event_hash", f"SELECT event_id, {HASH_SQL} AS hash FROM x")
def hsh01(spark: S, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", event_hash().alias("hash"))


@query("hsh02_chain_root", f"SELECT user_id, sha256(string_agg({HASH_SQL}, '' ORDER BY ts DESC, event_id DESC)) AS root, count(*) AS n FROM x GROUP BY user_id")
def hsh02(spark: S, d: str) -> DataFrame:
    return reports.chain_root(observations(spark, d).withColumn("hash", event_hash()), ["user_id"], "hash", ["ts", "event_id"])


@query("hsh06_manifest", "SELECT c_custkey, CASE WHEN o.h IS NULL THEN 'MISSING' WHEN o.h <> sha256(CAST(c_custkey % 3 AS VARCHAR)) THEN 'HASH_MISMATCH' ELSE 'OK' END AS state FROM customer LEFT JOIN (SELECT o_custkey, sha256(CAST(min(o_orderkey) % 3 AS VARCHAR)) AS h FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey", False)
def hsh06(spark: S, d: str) -> DataFrame:
    digest = lambda col: F.sha2((col % 3).cast("string"), 256)
    actual = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(digest(F.min("o_orderkey")).alias("h"))
    rows = table(spark, d, "customer").join(actual, "c_custkey", "left")
    return rows.select("c_custkey", F.when(F.col("h").isNull(), "MISSING").when(F.col("h") != digest(F.col("c_custkey")), "HASH_MISMATCH").otherwise("OK").alias("state"))


@query("arr01_distinct_in_order", "SELECT user_id, list_slice(list(event_id ORDER BY ts, event_id), -3, -1)[1] AS third_last FROM x GROUP BY user_id HAVING count(*) >= 3")
def arr01(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("l")).where(F.size("l") >= 3)
    return rows.select("user_id", F.element_at("l", -3)["event_id"].alias("third_last"))


@query("map01_by_camera", "SELECT user_id, k % 3 AS camera, count(*) AS n FROM x GROUP BY user_id, k % 3")
def map01(spark: S, d: str) -> DataFrame:
    lists = observations(spark, d).groupBy("user_id", (F.col("k") % 3).alias("c")).agg(F.collect_list("event_id").alias("l"))
    maps = lists.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "l"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("camera", "l")).select("user_id", "camera", F.size("l").cast("long").alias("n"))


@query("jsn01_bad_json", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN k % 4 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT), -1) AS k FROM x")
def jsn01(spark: S, d: str) -> DataFrame:
    x = observations(spark, d).withColumn("props", F.when(F.col("k") % 4 == 0, "{broken").otherwise(F.col("props")))
    return x.select("event_id", F.coalesce(F.from_json("props", "k long")["k"], F.lit(-1).cast("long")).alias("k"))
