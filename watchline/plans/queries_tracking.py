"""Queries of tracking, identities, evidence and evaluation, over things that move: an order is a thing, a line a sighting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchline.operators import evidence, frames, identities, tracking
from watchline.plans.base import observations, query
from watchline.plans.queries_state import boxes, recursive
from watchline.sources.tables import table

S = SparkSession

#: SQL of the rows that ``moving`` gives, as the common table m.
M = """m AS (
  SELECT l_orderkey * 8 + l_linenumber AS seq, l_orderkey // 256 AS camera_id, l_orderkey AS thing, l_orderkey % 256 + l_linenumber AS frame,
    ['car', 'truck', 'person'][l_orderkey % 3 + 1] AS class_name, q / 50.0 AS confidence,
    (l_orderkey * 37 % 1000 + (l_orderkey * 13 % 21 - 10) * l_linenumber)::DOUBLE AS x1, (l_orderkey * 91 % 500 + (l_orderkey * 7 % 21 - 10) * l_linenumber)::DOUBLE AS y1, 80.0 + l_orderkey % 60 AS w, 100.0 + l_orderkey % 70 AS h
  FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL))"""


def moving(spark: S, d: str) -> DataFrame:
    """Boxes of things that move straight on, some frames missing: 256 things a camera, one begins in every frame."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    kinds = F.array(*(F.lit(k) for k in ("car", "truck", "person")))
    number = lambda c: c.cast("double")
    m = rows.select(
        (o * 8 + n).alias("seq"), F.floor(o / 256).alias("camera_id"), o.alias("thing"), (o % 256 + n).alias("frame"), F.element_at(kinds, (o % 3 + 1).cast("int")).alias("class_name"), (F.col("q") / 50).alias("confidence"),
        number(o * 37 % 1000 + (o * 13 % 21 - 10) * n).alias("x1"), number(o * 91 % 500 + (o * 7 % 21 - 10) * n).alias("y1"), number(o % 60 + 80).alias("w"), number(o % 70 + 100).alias("h"),
    )
    return m.withColumns({"x2": F.col("x1") + F.col("w"), "y2": F.col("y1") + F.col("h")})


@query("str19_tracks")
def str19(spark: S, d: str) -> DataFrame:
    return tracking.tracked(moving(spark, d), "camera_id", "frame", "seq", high=0.3)


@query("str22_readopted")
def str22(spark: S, d: str) -> DataFrame:
    """Detections under the numbers that re-adoption leaves."""
    shown = tracking.continued(moving(spark, d), "camera_id", "frame", "seq", high=0.3, lost=30, only="detection")
    return shown.select("camera_id", "seq", "track_id", "hits", "object_class")


@query("str23_predicted")
def str23(spark: S, d: str) -> DataFrame:
    """Rows of frames without a detection of the track; only every second frame was looked at."""
    shown = tracking.continued(moving(spark, d).where("frame % 2 = 0"), "camera_id", "frame", "seq", high=0.3, lost=30, stride=2, only="prediction")
    return shown.select("camera_id", "frame", "track_id", "missed", *(F.round(c, 1).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("str15_identities")
def str15(spark: S, d: str) -> DataFrame:
    v = F.col("vec_id")
    e = table(spark, d, "embeddings").select((v % 16).alias("site"), v.alias("seq"), F.floor(v / 16).cast("double").alias("at"), F.concat(F.lit("CAM-"), v % 3).alias("camera"), F.col("label").cast("string").alias("track"), "embedding")
    return identities.matched(e, "site", "camera", "track", "at", "seq", "embedding").select("site", "seq", "identity", "decision", "confirmed")


@query(
    "j11_gallery_candidates",
    """WITH e AS (SELECT vec_id, vec_id % 4 AS site, vec_id / 4.0 AS at, embedding FROM embeddings),
    p AS (SELECT o.vec_id AS seq, g.vec_id AS identity, list_cosine_similarity(o.embedding::DOUBLE[], g.embedding::DOUBLE[]) AS score FROM e o JOIN e g ON o.site = g.site AND o.at - g.at > 0 AND o.at - g.at <= 45 WHERE o.vec_id % 5 <> 0 AND g.vec_id % 5 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, identity) AS n FROM p)
    SELECT a.seq, a.identity, round(a.score, 5) AS score, round(a.score - b.score, 5) AS lead, a.score >= 0.1 AND (b.score IS NULL OR a.score - b.score >= 0.08 OR a.score >= 0.3) AS linked
    FROM r a LEFT JOIN r b ON a.seq = b.seq AND b.n = 2 WHERE a.n = 1""",
    False,
)
def j11(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), (F.col("vec_id") % 4).alias("site"), (F.col("vec_id") / 4).alias("at"), F.col("embedding").alias("vector"))
    known = e.where("seq % 5 = 0").select("site", F.col("seq").alias("identity"), F.col("at").alias("seen"), F.col("vector").alias("mean"))
    found = identities.candidates(e.where("seq % 5 <> 0"), known, threshold=0.1, certain=0.3)
    return found.select("seq", "identity", F.round("score", 5).alias("score"), F.round("lead", 5).alias("lead"), "linked")


EVIDENCE_SQL = """, a AS (SELECT camera_id, CAST(floor(s / 3600) AS BIGINT) AS frame, user_id AS track, event_id AS seq FROM x),
    n AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame, seq) AS i FROM a),
    g AS (SELECT camera_id, i, frame, seq, 1 AS spent, MAP {track: {'f': frame, 'src': seq}} AS last, 'fresh' AS evidence, seq AS source FROM n WHERE i = 1
      UNION ALL SELECT camera_id, i, frame, seq, spent + CASE evidence WHEN 'fresh' THEN 1 WHEN 'reused' THEN 2 ELSE 0 END,
        CASE WHEN evidence IS NULL THEN last ELSE map_concat(last, MAP {track: {'f': frame, 'src': source}}) END, evidence, source
      FROM (SELECT *, CASE WHEN spent >= 3 THEN NULL WHEN recent THEN 'reused' ELSE 'fresh' END AS evidence, CASE WHEN spent >= 3 THEN NULL WHEN recent THEN last[track].src ELSE seq END AS source
        FROM (SELECT n.camera_id, n.i, n.frame, n.track, n.seq, g.last, CASE WHEN n.frame = g.frame THEN g.spent ELSE 0 END AS spent, coalesce(n.frame - g.last[n.track].f < 15, false) AS recent
          FROM g JOIN n ON n.camera_id = g.camera_id AND n.i = g.i + 1)))
    SELECT seq, evidence, source FROM g"""


@query("str28_plate_evidence", recursive(EVIDENCE_SQL), False)
def str28(spark: S, d: str) -> DataFrame:
    x = observations(spark, d).select("camera_id", F.floor(F.col("s") / 3600).alias("frame"), F.col("user_id").alias("track"), F.col("event_id").alias("seq"))
    return evidence.attached(x, "camera_id", "frame", "track", "seq").select("seq", "evidence", "source")


FILTER_SQL = f"""WITH RECURSIVE {M}, n AS (SELECT *, row_number() OVER (PARTITION BY thing ORDER BY frame) AS i FROM m),
    g AS (SELECT thing, i, seq, frame, x1 + w / 2 AS v, 0.0::DOUBLE AS r, pow(h / 10, 2) AS vv, 0.0::DOUBLE AS vr, pow(h / 16, 2) AS rr FROM n WHERE i = 1
      UNION ALL SELECT thing, i, seq, frame, pv + k * (z - pv), r + pvr / (pvv + noise) * (z - pv), pvv * (1 - k), pvr * (1 - k), prr - pvr * pvr / (pvv + noise)
      FROM (SELECT *, pvv / (pvv + noise) AS k FROM (SELECT n.thing, n.i, n.seq, n.frame, n.x1 + n.w / 2 AS z, g.v + g.r AS pv, g.r, g.vv + 2 * g.vr + g.rr + pow(n.h / 20, 2) AS pvv, g.vr + g.rr AS pvr, g.rr + pow(n.h / 160, 2) AS prr, pow(n.h / 20, 2) AS noise
        FROM g JOIN n ON n.thing = g.thing AND n.i = g.i + 1)))
    SELECT seq, round(v, 4) AS x, round(r, 4) AS vx FROM g"""


@query("str20_filtered", FILTER_SQL, False)
def str20(spark: S, d: str) -> DataFrame:
    """Each thing's place across and its speed as the filter has them after each sighting; its height doesn't change."""
    found = tracking.filtered(moving(spark, d), ["thing"], "frame", "seq")
    return found.select("seq", F.round("x", 4).alias("x"), F.round("vx", 4).alias("vx"))


def sides(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    """True boxes of moving things, and predictions: shifted, some missing, under numbers that change in the fifth sighting."""
    m = moving(spark, d)
    truth = m.select("camera_id", "frame", F.col("thing").alias("id"), F.lit(True).alias("is_truth"), *frames.BOX)
    shift = F.col("seq") % 40
    moved = {c: F.col(c) + shift for c in frames.BOX}
    guess = m.where("seq % 11 <> 0").withColumns(moved).select("camera_id", "frame", (F.col("thing") * 10 + (F.col("seq") % 8 >= 5).cast("long")).alias("id"), F.lit(False).alias("is_truth"), *frames.BOX)
    return truth, guess


def greedy_match_sql(rows: str, least: float) -> str:
    """SQL of the greedy match of ``rows`` (f: the frame, id, is_truth, boxes): true boxes by id, each with its best free prediction."""
    return f"""b AS ({rows}),
    p AS (SELECT t.f, t.id AS truth_id, q.id AS q, greatest(0, least(t.x2, q.x2) - greatest(t.x1, q.x1)) * greatest(0, least(t.y2, q.y2) - greatest(t.y1, q.y1)) AS common, (t.x2 - t.x1) * (t.y2 - t.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) AS areas
      FROM b t JOIN b q ON t.f = q.f WHERE t.is_truth AND NOT q.is_truth),
    c AS (SELECT f, truth_id, list({{'iou': common / (areas - common), 'q': q}} ORDER BY common / (areas - common) DESC, q) AS found FROM p WHERE common / (areas - common) >= {least} GROUP BY ALL),
    n AS (SELECT b.f, b.id, coalesce(c.found, []) AS found, row_number() OVER (PARTITION BY b.f ORDER BY b.id) AS i FROM b LEFT JOIN c ON c.f = b.f AND c.truth_id = b.id WHERE b.is_truth),
    g AS (SELECT f, i, id, found[1] AS hit, [found[1].q] AS used FROM n WHERE i = 1
      UNION ALL SELECT f, i, id, hit, list_append(used, hit.q) FROM (SELECT n.f, n.i, n.id, g.used, list_filter(n.found, lambda e: NOT list_contains(g.used, e.q))[1] AS hit FROM g JOIN n ON n.f = g.f AND n.i = g.i + 1))"""


J13_ROWS = "SELECT {'camera_id': camera_id, 'k': k} AS f, event_id AS id, event_id % 2 = 0 AS is_truth, x AS x1, y AS y1, x + 300 AS x2, y + 300 AS y2 FROM x"


@query("j13_ground_truth", recursive(", " + greedy_match_sql(J13_ROWS, 0.4) + " SELECT f.camera_id AS camera_id, f.k AS k, id AS truth_id, hit.q AS prediction_id, round(coalesce(hit.iou, 0), 6) AS iou FROM g"), False)
def j13(spark: S, d: str) -> DataFrame:
    b = boxes(spark, d).select("camera_id", "k", F.col("event_id").alias("id"), (F.col("event_id") % 2 == 0).alias("is_truth"), *frames.BOX)
    return frames.greedy_ground_truth(b, ["camera_id", "k"], 0.4).withColumn("iou", F.round("iou", 6))


SIDES_ROWS = """SELECT {'camera_id': camera_id, 'frame': frame} AS f, thing AS id, true AS is_truth, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM m
  UNION ALL SELECT {'camera_id': camera_id, 'frame': frame}, thing * 10 + CASE WHEN seq % 8 >= 5 THEN 1 ELSE 0 END, false, x1 + seq % 40, y1 + seq % 40, x1 + w + seq % 40, y1 + h + seq % 40 FROM m WHERE seq % 11 <> 0"""


@query(
    "agg24_evaluation",
    f"""WITH RECURSIVE {M}, {greedy_match_sql(SIDES_ROWS, 0.5)},
    s AS (SELECT *, lag(hit.q) OVER (PARTITION BY f.camera_id, id ORDER BY f.frame) AS before FROM g WHERE hit IS NOT NULL),
    t AS (SELECT count(*) AS tp, count(*) FILTER (WHERE before <> hit.q) AS id_switches FROM s), a AS (SELECT count(*) FILTER (WHERE is_truth) AS n_truth, count(*) FILTER (WHERE NOT is_truth) AS n_predicted FROM b)
    SELECT tp, n_predicted - tp AS fp, n_truth - tp AS fn, round(tp / greatest(1, n_predicted), 4) AS "precision", round(tp / greatest(1, n_truth), 4) AS recall, id_switches FROM t, a""",
    False,
)
def agg24(spark: S, d: str) -> DataFrame:
    truth, guess = sides(spark, d)
    return frames.evaluated(truth, guess, ["camera_id"], "frame", 0.5)


ASSIGNED_SQL = f""", b AS ({J13_ROWS}),
    p AS (SELECT f, t, q, 1 - common / (180000 - common) AS cost FROM (SELECT t.f, t.id AS t, q.id AS q, greatest(0, least(t.x2, q.x2) - greatest(t.x1, q.x1)) * greatest(0, least(t.y2, q.y2) - greatest(t.y1, q.y1)) AS common FROM b t JOIN b q ON t.f = q.f AND t.is_truth AND NOT q.is_truth)),
    n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY cost, t, q) AS i FROM p WHERE cost <= 0.8),
    g AS (SELECT f, i, t, q, cost, true AS taken, [t] AS ts, [q] AS qs FROM n WHERE i = 1
      UNION ALL SELECT f, i, t, q, cost, taken, CASE WHEN taken THEN list_append(ts, t) ELSE ts END, CASE WHEN taken THEN list_append(qs, q) ELSE qs END
      FROM (SELECT n.*, g.ts, g.qs, NOT (list_contains(g.ts, n.t) OR list_contains(g.qs, n.q)) AS taken FROM g JOIN n ON n.f = g.f AND n.i = g.i + 1))
    SELECT t AS track_id, q AS box_id, round(cost, 6) AS cost FROM g WHERE taken"""


@query("str21_assignment", recursive(ASSIGNED_SQL), False)
def str21(spark: S, d: str) -> DataFrame:
    b = boxes(spark, d).select("camera_id", "k", F.col("event_id").alias("id"), (F.col("event_id") % 2 == 0).alias("is_track"), *frames.BOX)
    return frames.assignments(b, ["camera_id", "k"]).select("track_id", "box_id", F.round("cost", 6).alias("cost"))
