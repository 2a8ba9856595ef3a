import random

import numpy as np
import pyarrow as pa
import pytest

from tests.plain_tracker import Tracker, continued
from watchline.operators import ordered, tracking

SCHEMA = "camera long, frame long, seq long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def scene(rng, n, length, gap=None):
    """Detections of things that move, come, go, hide and change their names; ``gap``: frames in which nothing is seen."""
    rows, seq = {}, 0
    for _ in range(n):
        start, life = rng.randrange(length), rng.randrange(4, 50)
        x, y, w, h = rng.uniform(0, 1000), rng.uniform(0, 500), rng.uniform(30, 200), rng.uniform(40, 200)
        vx, vy = rng.choice([(0, 0), (rng.uniform(-14, 14), rng.uniform(-9, 9))])
        names = rng.choice([["car", "bus"], ["person"], ["car", None], ["truck"]])
        hidden = range(0) if rng.random() < 0.4 else range(start + 5, start + 5 + rng.randrange(1, 14))
        for f in range(start, min(start + life, length)):
            x, y = x + vx + rng.uniform(-2, 2), y + vy + rng.uniform(-2, 2)
            if f in hidden or rng.random() < 0.12 or (gap and f in gap):
                continue
            seq += 1
            rows.setdefault(f, []).append((seq, [x, y, x + w, y + h], round(rng.uniform(0.05, 1), 3), rng.choice(names)))
    return {f: sorted(r, key=lambda r: (-r[2], r[0])) for f, r in sorted(rows.items())}


def table(spark, scenes):
    rows = [(cam, f, seq, name, score, *box) for cam, frames in scenes.items() for f, some in frames.items() for seq, box, score, name in some]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def batch(spark):
    def size(n):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)

    yield size
    size(10000)


def bands(frames, high, lost):
    tracker, out = Tracker(high, lost, 0.8), []
    for f in range(min(frames), max(frames) + 1):
        rows = frames.get(f, [])
        out += [(rows[j][0], t.id) for t, j in tracker.update([r[1] for r in rows], [r[2] for r in rows])]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 7, 10000])
def test_bands_against_a_plain_tracker_at_any_batch_length(spark, batch, size):
    batch(size)
    scenes = {1: scene(random.Random(1), 30, 120), 2: scene(random.Random(2), 40, 200, gap=range(60, 80)), 3: scene(random.Random(3), 5, 300)}
    got = tracking.tracked(table(spark, scenes), "camera", "frame", "seq", high=0.5, lost=8).collect()
    for cam, frames in scenes.items():
        assert sorted((r.seq, r.track_id) for r in got if r.camera == cam) == bands(frames, 0.5, 8)


@pytest.mark.parametrize(("size", "stride"), [(3, 1), (10000, 1), (10000, 2), (11, 3)])
def test_continuity_against_a_plain_tracker(spark, batch, size, stride):
    batch(size)
    scenes = {k: {f: r for f, r in scene(random.Random(10 + k), 30, 150, gap=range(70, 95)).items() if f % stride == 0} for k in range(3)}
    got = tracking.continued(table(spark, scenes), "camera", "frame", "seq", high=0.3, lost=12, stride=stride)
    names = ["seq", "frame", "track_id", "provenance", "hits", "missed", "object_class", "x1", "y1", "x2", "y2"]
    rows = got.collect()
    adopted = 0
    for cam, frames in scenes.items():
        mine = sorted((tuple(r[c] for c in names) for r in rows if r.camera == cam), key=repr)
        expected = sorted(continued(frames, 0.3, 12, 0.82, stride), key=repr)
        assert [r[:7] for r in mine] == [r[:7] for r in expected]
        # boxes are rounded to hundredths at every step
        assert all(abs(a - b) < 0.3 for m, e in zip(mine, expected, strict=True) for a, b in zip(m[7:], e[7:], strict=True))
        assert all(r[5] <= 12 for r in mine)
        plain = dict(bands(frames, 0.3, 12))
        adopted += sum(r[0] in plain and plain[r[0]] != r[2] for r in mine)
    assert stride > 1 or adopted  # some box got another number than without re-adoption


def test_rounds_as_python_does():
    v = np.concatenate([np.random.default_rng(1).integers(-10**6, 10**6, 20_000) / 1000, np.random.default_rng(2).uniform(-2000, 2000, 20_000), [0.125, 2.675, -0.001, 0.0]])
    assert tracking.hundredths(v).tolist() == [round(x, 2) for x in v.tolist()]


@pytest.mark.parametrize("block", [1, 50, 200_000])
def test_many_cameras_side_by_side(monkeypatch, spark, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    scenes = {k: scene(random.Random(20 + k), 12, 60, gap=range(20, 20 + 3 * k)) for k in range(12)}
    rows = table(spark, scenes)
    named = tracking.tracked(rows, "camera", "frame", "seq", high=0.5, lost=8).collect()
    shown = tracking.continued(rows, "camera", "frame", "seq", high=0.3, lost=12, only="detection").collect()
    for cam, frames in scenes.items():
        assert sorted((r.seq, r.track_id) for r in named if r.camera == cam) == bands(frames, 0.5, 8)
        wanted = sorted((r[0], r[2], r[4]) for r in continued(frames, 0.3, 12, 0.82, 1) if r[3] == "detection")
        assert sorted((r.seq, r.track_id, r.hits) for r in shown if r.camera == cam) == wanted


def test_steps_do_not_grow_with_the_cameras(spark):
    state, steps = tracking.Named(tracking.Bands(0.5, 0.1, 8, 0.8), False), []
    update = state.bands.update
    state.bands.update = lambda *a: steps.append(len(a[0])) or update(*a)
    state.open(np.zeros(500, np.int64))
    lanes = np.arange(500)
    for f in range(5):
        box = [pa.array(np.full(500, v)) for v in (10.0, 10.0, 50.0, 60.0, 0.9)]
        found = list(state.step(lanes, np.full(500, f), lanes, [*box, pa.array(lanes)]))
        assert len(found[0][0]) == 500
    assert steps == [500] * 5


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tracking.tracked(empty, "camera", "frame", "seq").collect() == []
    assert tracking.continued(empty, "camera", "frame", "seq").collect() == []
