"""Zone files, stored files, folds by key, plates and life cycles against literal expectations and plain loops."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tests.test_state import at
from watchline.operators import folds, incidents, plates, records, reports
from watchline.sources import definitions, ground_truth, snapshots
from watchline.streaming import stateful


def test_zone_file_is_read_with_defaults(spark, tmp_path):
    zone = {"zone_id": "Z1", "name": "gate", "polygon": [[0, 0], [4, 0], [4, 4]], "severity": "high"}
    demo = {"zone_id": "BORDER_RESTRICTED_STRIP_01", "name": "demo", "polygon": []}
    wire = {"boundary_id": "B1", "name": "line", "pt1": [1, 2], "pt2": [3, 4]}
    (tmp_path / "zones.json").write_text(json.dumps({"zones": [zone, demo], "boundaries": [wire]}, indent=2))
    (tmp_path / "broken.json").write_text("{")
    read = definitions.read_documents(spark, str(tmp_path))
    found = {r.zone_id: r for r in definitions.zones_of(read).collect()}
    assert (found["Z1"].severity, found["Z1"].is_active, found["Z1"].loitering_debounce_seconds, found["Z1"].polygon[1].x) == ("critical", True, 30.0, 4.0)
    assert (found[demo["zone_id"]].severity, found[demo["zone_id"]].is_active) == ("restricted", False)
    (b,) = definitions.boundaries_of(read).collect()
    assert (b.boundary_id, b.ax, b.by, b.severity, b.direction, b.debounce_seconds) == ("B1", 1.0, 4.0, "critical", "BIDIRECTIONAL", 3.0)


def test_files_are_listed_and_verified(spark, tmp_path):
    (tmp_path / "a_1.jpg").write_bytes(b"one")
    (tmp_path / "b_1.jpg").write_bytes(b"two")
    assert [(r.name, r.length) for r in snapshots.listed(spark, str(tmp_path), "a_*").collect()] == [("a_1.jpg", 3)]
    files = snapshots.digests(spark, str(tmp_path))
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in files.collect()}
    good = hashlib.sha256(b"one").hexdigest()
    rows = [(1, paths["a_1.jpg"], good), (2, paths["b_1.jpg"], good), (3, "gone", good), (4, None, good), (5, paths["a_1.jpg"], None), (6, " ", None)]
    got = records.verified(spark.createDataFrame(rows, "id int, path string, stored string"), files).collect()
    assert {r.id: r.status for r in got} == {1: "VERIFIED", 2: "COMPROMISED", 3: "MISSING", 4: "INVALID", 5: "INVALID", 6: "INVALID"}


def test_short_and_odd_lines_of_ground_truth(spark):
    lines = spark.createDataFrame([("1,7,0,0,2,2,1",), ("1,8,0,0,2,2,1,2,1",), ("1,9,0,0,2",), ("",), (None,), ("1,5,x,0,2,2,1,1,0.05",)], "value string")
    assert [r.track_id for r in ground_truth.pedestrians(lines).collect()] == [7]
    assert [(r.track_id, r.category) for r in ground_truth.aerial(lines).collect()] == [(8, 2), (5, 1)]


def test_cooldown_with_one_sequence_over_keys_and_null_keys(spark):
    rows = [(1, "a", at(0)), (1, "b", at(0)), (2, "a", at(3)), (2, "b", at(9)), (1, None, at(0)), (2, None, at(1))]
    df = spark.createDataFrame(rows, "seq long, key string, ts timestamp_ntz")
    got = {(r.key, r.seq) for r in folds.emit_with_cooldown(df, ["key"], "ts", "seq", 5).collect()}
    assert got == {("a", 1), ("b", 1), ("b", 2), (None, 1)}


def test_leaky_alarms_and_last_smoothed_against_loops(spark):
    rng = random.Random(3)
    rows = [(key, i, rng.random() < 0.55, rng.random()) for key in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "key string, seq long, bad boolean, v double")
    want, level, smooth = set(), {}, {}
    for key, i, bad, v in rows:
        level[key] = level.get(key, 0) + 1 if bad else max(level.get(key, 0) - 1, 0)
        smooth[key] = v if key not in smooth else 0.4 * v + 0.6 * smooth[key]
        if level[key] >= 3:
            want.add((key, i))
    assert {(r.key, r.seq) for r in folds.leaky_alarms(df, ["key"], ["seq"], "bad").where("alarm").collect()} == want
    got = {r.key: r.smoothed for r in folds.last_smoothed(df, ["key"], ["seq"], "v", 0.4).collect()}
    assert all(abs(got[k] - smooth[k]) < 1e-12 for k in smooth) and got.keys() == smooth.keys()


def test_plate_consensus(spark):
    rows = [("t", i, p, c, s) for i, (p, c, s) in enumerate([("AB10", 0.5, 10.0), ("ABIO", 0.48, 300.0), ("XYZ9", 0.55, 0.0)])] + [("u", 9, "CD11", 0.5, 0.0), ("v", 9, None, 0.9, 0.0)]
    df = spark.createDataFrame(rows, "track string, seq long, text string, confidence double, sharpness double")
    got = {r.track: tuple(r)[1:] for r in plates.consensus(df, "track", ["seq"]).collect()}
    assert got == {"t": ("AB10", 0.5, 2, "CONSENSUS"), "u": ("CD11", 0.5, 1, "UNCERTAIN")}
    assert plates.consensus(df, "track", ["seq"], sharpness="sharpness").where("track = 't'").first().plate == "ABIO"


def test_an_action_ends_an_incident(spark):
    rows = [(1, at(0), 40.0, None), (2, at(5), 75.0, "RESOLVED"), (3, at(6), 10.0, None), (4, at(7), 20.0, None)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, score double, action string").withColumn("key", F.lit("k"))
    got = incidents.life_cycle(df, ["key"], "ts", "seq", "score", 60.0, "action").orderBy("incident").collect()
    assert [(r.n_events, r.status, r.peak_threat) for r in got] == [(2, "RESOLVED", 75.0), (2, "ACTIVE", 20.0)]


def test_churn_across_spans(spark):
    rows = [(1, "a"), (999, "a"), (999, "b"), (1000, "b"), (5000, "b"), (5000, "c")]
    got = reports.churn(spark.createDataFrame(rows, "frame long, track string"), "frame", "track").orderBy("frame").collect()
    assert [(r.frame, r.n_new, r.n_kept) for r in got] == [(1, 1, 0), (999, 1, 1), (1000, 0, 1), (5000, 1, 1)]


def test_keys_of_earlier_batches_are_not_published_again(spark, tmp_path):
    published = []
    run = stateful.persisted_then_published(str(tmp_path / "out"), lambda df, n: published.append((n, sorted(r.event_id for r in df.collect()))))
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "event_id long")
    run(batch(1, 2, 2), 0)
    run(batch(2, 3), 1)
    run(batch(2, 3), 1)
    assert published == [(0, [1, 2]), (1, [3]), (1, [3])]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_payload_is_parsed_once(spark):
    from watchline.operators import events

    rows = spark.createDataFrame([(1, '{"message": "m", "severity": "low"}'), (2, "{broken"), (3, None)], "event_id long, payload string")
    items = events.alert_items(rows)
    assert plan(items).count("from_json") == 1
    assert [(r.message, r.severity) for r in items.orderBy("event_id").collect()] == [("m", "LOW"), ("Security Perimeter Violation", "CRITICAL"), ("Security Perimeter Violation", "CRITICAL")]


def test_closing_targets_write_no_column_out_twice(spark):
    from watchline.plans.queries_reports import j09

    shown = plan(j09(spark, "/root/testdata/sf0.001"))
    assert len(shown) < 10_000 and "Python" not in shown and "ExistingRDD" not in shown


def test_a_site_has_documents_of_a_bounded_length(spark):
    stored = spark.range(7).select((F.col("id") % 2).alias("site"), F.concat(F.lit("Z"), "id").alias("zone_id"), F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))).alias("polygon"), F.lit("critical").alias("severity"))
    documents = definitions.documents_from(stored, "site", 3)
    assert sorted((r.site, r.value.count("zone_id")) for r in documents.collect()) == [(0, 1), (0, 3), (1, 3)]
    assert sorted(r.zone_id for r in definitions.zones_of(documents).collect()) == [f"Z{i}" for i in range(7)]
