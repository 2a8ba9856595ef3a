"""A stream gives what the batch operator gives."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from watchline.functions import geo
from watchline.operators import folds, incidents, zones
from watchline.streaming import stateful

T0 = datetime(2026, 8, 22, 12)
SCHEMA = "event_id long, track string, ts timestamp, x double, y double, score double, object_class string, camera_id long"
SQUARE = [(100, 100), (300, 100), (300, 300), (100, 300)]


@pytest.fixture()
def source(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), T0 + timedelta(seconds=7 * i + rng.random()), rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(0, 100), rng.choice(["p", "c"]), rng.randint(1, 3)) for i in range(150)]
    for part in range(3):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return stream, spark.read.parquet(f"{tmp_path}/in"), tmp_path


def result(spark, out, tmp_path, name):
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_debounce(spark, source):
    stream, batch, path = source
    got = result(spark, stateful.debounced(stream, ["track"], "ts", "event_id", 30), path, "deb")
    want = folds.emit_with_cooldown(batch, ["track"], "ts", "event_id", 30)
    assert {r.event_id for r in got.collect()} == {r.event_id for r in want.collect()}


def test_zone_transitions(spark, source):
    stream, batch, path = source
    table = spark.range(1).select(F.lit("z").alias("zone_id"), geo.polygon(SQUARE).alias("polygon"), F.lit(True).alias("is_active"))
    got = result(spark, stateful.zone_transitions(stream, ["track"], "ts", "event_id", table), path, "zon")
    want = zones.transitions(zones.positions_in_zones(batch, table), ["track"], "ts", "event_id")
    key = lambda df: sorted((r.event_id, r.transition, round(r.dwell_seconds, 3)) for r in df.collect() if r.event_id is not None)
    assert key(got) == key(want) != []


def comers(spark, path, n=240, size=20):
    """Tracks that come one after the other, are seen four times inside or outside, and are gone; in files by time."""
    rng = random.Random(7)
    rows = []
    for k in range(n):
        for j in range(4):
            inside = rng.random() < 0.6
            rows.append((4 * k + j, f"t{k}", T0 + timedelta(seconds=60 * k + 11 * j), 200.0 if inside else 0.0, 200.0, 0.0, "p", 1))
    for i in range(0, n, size):
        spark.createDataFrame(rows[4 * i : 4 * (i + size)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are taken by their age
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def run(out, path, name):
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_dormant_tracks_leave_and_state_stays_small(spark, tmp_path):
    stream, batch = comers(spark, f"{tmp_path}/in")
    table = spark.range(1).select(F.lit("z").alias("zone_id"), geo.polygon(SQUARE).alias("polygon"), F.lit(True).alias("is_active"))
    sizes = run(stateful.zone_transitions(stream, ["track"], "ts", "event_id", table, dormant=300.0), tmp_path, "dor")
    got = spark.table("dor").collect()
    inside = zones.positions_in_zones(batch, table)
    exits = {round(r["at"], 3) for r in zones.dormant_exits(inside, ["track"], "ts", "event_id", 300.0).collect()}
    timed = [round(r["at"], 3) for r in got if r.event_id is None]
    assert len(timed) == len(set(timed)) and set(timed) <= exits and len(timed) > 0.8 * len(exits)  # the last ones' time hasn't come
    want = zones.transitions(inside, ["track"], "ts", "event_id", dormant=300.0).collect()
    assert sorted((r.event_id, r.transition) for r in got if r.event_id is not None) == sorted((r.event_id, r.transition) for r in want)
    assert max(sizes) < 80 and len(exits) > 100  # 240 tracks in all


def test_debounce_forgets_idle_keys(spark, tmp_path):
    stream, batch = comers(spark, f"{tmp_path}/in")
    sizes = run(stateful.debounced(stream, ["track"], "ts", "event_id", 20), tmp_path, "idle")
    want = folds.emit_with_cooldown(batch, ["track"], "ts", "event_id", 20)
    assert {r.event_id for r in spark.table("idle").collect()} == {r.event_id for r in want.collect()}
    assert max(sizes) < 80
    assert max(run(stateful.tripwire_crossings(stream, ["track"], "ts", "event_id", (100.0, 0.0, 100.0, 400.0), dormant=60.0), tmp_path, "wire")) < 80


def test_late_rows_are_dropped(spark, tmp_path):
    stream, _ = comers(spark, f"{tmp_path}/in", n=60)
    late = [(9000, "t0", T0 + timedelta(seconds=1), 200.0, 200.0, 0.0, "p", 1)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(stateful.debounced(stream, ["track"], "ts", "event_id", 1), tmp_path, "late")
    assert spark.table("late").where("event_id = 9000").isEmpty() and spark.table("late").count() == 240


def test_tripwire(spark, source):
    stream, batch, path = source
    got = result(spark, stateful.tripwire_crossings(stream, ["track"], "ts", "event_id", (0.0, 200.0, 400.0, 200.0)), path, "tri")
    wires = spark.createDataFrame([("w", 0.0, 200.0, 400.0, 200.0, "BIDIRECTIONAL", True)], "boundary_id string, ax double, ay double, bx double, by double, direction string, is_active boolean")
    want = folds.emit_with_cooldown(zones.tripwire_crossings(batch, wires, ["track"], "ts", "event_id"), ["track"], "ts", "event_id", 3.0)
    key = lambda df: sorted((r.event_id, r.crossing) for r in df.collect())
    assert key(got) == key(want) != []


def test_incident_sessions(spark, source):
    stream, batch, path = source
    got = {(r.track, r.n_events) for r in result(spark, stateful.incident_sessions(stream, ["track"], "ts", "score", "20 seconds"), path, "inc").collect()}
    want = {(r.track, r.n_events) for r in incidents.incidents(incidents.numbered_incidents(batch, ["track"], "ts", "event_id", 20), ["track"], "ts", "event_id", "score").collect()}
    assert got and got <= want


def test_sink_numbers_rows_and_survives_retries(spark, source):
    _, batch, path = source
    days = F.to_date("ts")
    published, failures = [], [RuntimeError("busy"), RuntimeError("busy")]
    append = stateful.persisted_then_published(f"{path}/log", lambda df, n: published.append((n, df.count())), order=["ts", "event_id"], day=days)
    parts = [batch.where(f"event_id % 3 = {k}") for k in range(3)]
    append(parts[0], 0)
    append(parts[1], 1)
    append(parts[1], 1)  # a batch that is run again
    append(parts[2].union(parts[0].where("event_id < 30")), 2)  # with rows that are stored already
    rows = spark.read.parquet(f"{path}/log").orderBy("seq_id").collect()
    assert [r.seq_id for r in rows] == list(range(1, 151)) and len({r.event_id for r in rows}) == 150
    assert [r.event_id for r in rows if r.batch == 1] == [r.event_id for r in parts[1].orderBy("ts", "event_id").collect()]
    assert [n for n, _ in published] == [0, 1, 1, 2] and published[-1] == (2, 50)

    def flaky():
        if failures:
            raise failures.pop()
        return "stored"

    waits = []
    assert stateful.retried(flaky, pause=waits.append) == "stored" and waits == [0.010, 0.025]
    with pytest.raises(RuntimeError):
        stateful.retried(lambda: (_ for _ in ()).throw(RuntimeError("busy")), retries=2, pause=waits.append)


def test_sink_keeps_a_key_once(spark, source):
    stream, _, path = source
    seen = []
    run = stateful.persisted_then_published(f"{path}/events", lambda df, n: seen.append((n, df.count())))
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/sink").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{path}/events").count() == sum(n for _, n in seen) == 150


def test_correlated_pairs_do_not_grow_with_the_exits_before_an_entry(spark, tmp_path):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=rng.randrange(500)), k % 3, 0, rng.random() < 0.5) for k in range(240)]
    for n in range(3):  # in three batches, out of order
        spark.createDataFrame(rows[n * 80 : n * 80 + 80], "event_id long, ts timestamp, camera_id long, object_class long, is_exit boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, camera_id long, object_class long, is_exit boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pairs = stateful.run_to_end(stateful.correlated(stream.where("is_exit"), stream.where("NOT is_exit"), 3600), str(tmp_path / "out"))
    wanted = {}
    for e in (r for r in rows if not r[4]):
        found = [x for x in rows if x[4] and x[2] != e[2] and 0.5 <= (e[1] - x[1]).total_seconds() <= 3600]
        if found:
            wanted[e[0]] = max(found, key=lambda x: (x[1], x[0]))[0]
    assert {r.entry_id: r.exit_id for r in stateful.latest_exits(pairs).collect()} == wanted
    assert pairs.count() <= 3 * len(wanted)
