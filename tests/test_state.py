"""Literal expectations and plain models for stateful operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from watchline.functions import geo
from watchline.operators import folds, frames, incidents, tracking, zones

T0 = datetime(2026, 8, 22, 12)
SQUARE = [(100, 100), (300, 100), (300, 300), (100, 300)]


def at(s):
    return T0 + timedelta(seconds=s)


def positions(spark, rows):
    df = spark.createDataFrame([(i, "t", at(s), float(x), float(y)) for i, (s, x, y) in enumerate(rows)], "seq long, track string, ts timestamp_ntz, x double, y double")
    return df.withColumn("zone_id", F.lit("z")).withColumn("inside", geo.zone_contains(F.col("x"), F.col("y"), geo.polygon(SQUARE)))


def test_zone_transitions(spark):
    rows = positions(spark, [(0, 0, 0), (1, 200, 200), (2, 210, 210), (9, 350, 200)])
    got = zones.transitions(rows, ["track"], "ts", "seq").orderBy("seq").collect()
    assert [(r.seq, r.transition, r.dwell_seconds) for r in got] == [(1, "entered", 0.0), (3, "exited", 8.0)]
    assert zones.transitions(rows.where("seq > 0"), ["track"], "ts", "seq", initial_inside_enters=False).collect() == []


def test_loitering(spark):
    rows = positions(spark, [(s, 200, 200) for s in (0, 11, 12, 25, 45)])
    got = zones.loitering(rows, ["track"], "ts", "seq", 10, 30).orderBy("seq").collect()
    assert [r.dwell_seconds for r in got] == [11, 45]


def test_dwell_starts_anew(spark):
    rows = positions(spark, [(0, 200, 200), (5, 200, 200), (6, 0, 0), (20, 200, 200), (25, 200, 200)])
    got = zones.transitions(rows, ["track"], "ts", "seq").orderBy("seq").collect()
    assert [(r.transition, r.dwell_seconds) for r in got] == [("entered", 0.0), ("exited", 6.0), ("entered", 0.0)]
    assert zones.loitering(rows, ["track"], "ts", "seq", 10, 30).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_cooldown_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), at(rng.randint(0, 60)), rng.random() < 0.1) for i in range(200)]
    want, last = set(), {}
    for i, key, ts, bypass in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or bypass or (ts - last[key]).total_seconds() >= 5:
            want.add(i)
            last[key] = ts
    df = spark.createDataFrame(rows, "seq long, key string, ts timestamp_ntz, b boolean")
    assert {r.seq for r in folds.emit_with_cooldown(df, ["key"], "ts", "seq", 5, bypass=F.col("b")).collect()} == want


def test_cooldown_counts_from_the_last_emitted(spark):
    df = spark.createDataFrame([(i, "k", at(s)) for i, s in enumerate((0, 3, 6, 9, 11))], "seq long, key string, ts timestamp_ntz")
    assert {r.seq for r in folds.emit_with_cooldown(df, ["key"], "ts", "seq", 5).collect()} == {0, 2, 4}


def test_hundred_events_one_alert(spark):
    df = spark.createDataFrame([(i, "e", at(i), 45 + 0.3 * i) for i in range(100)], "seq long, entity string, ts timestamp_ntz, score double")
    rows = incidents.incidents(incidents.numbered_incidents(df, ["entity"], "ts", "seq", 120), ["entity"], "ts", "seq", "score")
    got = incidents.suppression(rows).first()
    assert (got.n_events, got.n_incidents, got.n_alerts) == (100, 1, 1) and rows.first().suppressed == 99


def test_gap_is_inclusive_and_closing_splits(spark):
    df = spark.createDataFrame([(i, "e", at(s), c) for i, (s, c) in enumerate([(0, False), (120, False), (241, False), (250, True), (251, False)])], "seq long, e string, ts timestamp_ntz, closed boolean")
    got = incidents.numbered_incidents(df, ["e"], "ts", "seq", 120, closes=F.col("closed")).orderBy("seq").collect()
    assert [r.incident for r in got] == [1, 1, 2, 2, 3]


def test_suppression_without_events(spark):
    empty = spark.createDataFrame([], "n_events long, alert_severity string")
    assert incidents.suppression(empty).first().suppression_rate == 100.0


def detections(spark, rows):
    return spark.createDataFrame([(0, i, n, float(c), *map(float, b)) for i, (n, c, b) in enumerate(rows)], "frame int, id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([("bus", 0.35, (100, 100, 260, 300)), ("truck", 0.30, (104, 98, 264, 302))], [0]),
        ([("car", 0.5, (0, 0, 50, 50)), ("car", 0.4, (500, 0, 550, 50))], [0, 1]),
        ([("car", 0.5, (10, 10, 200, 160)), ("person", 0.6, (210, 60, 240, 150))], [0, 1]),
    ],
)
def test_cross_class_duplicates(spark, rows, kept):
    got = frames.without_cross_class_duplicates(detections(spark, rows), ["frame"]).collect()
    assert sorted(r.id for r in got) == kept


def test_coordinated_group(spark):
    rows = [(0, "T1", 120.0, 150.0, 8.0, 2.0), (0, "T2", 150.0, 160.0, 8.5, 2.2), (0, "T3", 420.0, 450.0, -5.0, 8.0)]
    got = frames.coordinated_groups(spark.createDataFrame(rows, "frame int, track_id string, x double, y double, vx double, vy double"), ["frame"]).collect()
    assert [r.tracks for r in got] == [["T1", "T2"]]


def test_tracker_keeps_an_object(spark):
    rows = [(0, f, f, 0.9, 10.0 + 4 * f, 10.0, 60.0 + 4 * f, 110.0) for f in range(10) if f != 5] + [(0, f, 20 + f, 0.8, 400.0, 300.0, 450.0, 380.0) for f in range(10)]
    df = spark.createDataFrame(rows, "camera int, frame int, seq long, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = tracking.tracked(df, "camera", "frame", "seq").groupBy("track_id").count().collect()
    assert sorted(r["count"] for r in got) == [9, 10]


def test_votes_and_smoothing(spark):
    row = spark.range(1).select(
        folds.majority_vote(F.array(*map(F.lit, "bacab"))).alias("m"), folds.smoothed(F.array(F.lit(1.0), F.lit(2.0)), 0.5).alias("s"),
        folds.leaky_alarm(F.array(*map(F.lit, [True, True, True, False, False]))).alias("a"),
    ).first()
    assert row.m == "b" and row.s == [1.0, 1.5] and row.a == [False, False, True, False, False]
