"""Greedy operators within crowded frames against plain ones with all pairs at once."""

import resource

import numpy as np
import pandas as pd
import pytest

from watchline.operators import frames


def crowd(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    corner = rng.integers(0, 60, (n, 2)) * 5.0
    return np.concatenate([corner, corner + rng.choice([20, 30, 60], (n, 1))], axis=1)


def plain(boxes, names, scores, clash) -> list[int]:
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: (-scores[i], i)):
        if not any(clash(i, j) for j in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("name", ["str24", "str25", "str26"])
def test_kept_of_a_frame(spark, name):
    """The rows that a comparison of all with all keeps, though only kept rows are compared."""
    n = 150
    boxes, rng = crowd(n, 1), np.random.default_rng(2)
    names, scores = rng.choice(["car", "truck", "person"], n), rng.integers(0, 20, n) / 20
    shared = frames.overlaps(boxes, boxes)
    centre = (boxes[:, :2] + boxes[:, 2:]) / 2
    vehicles = lambda i, j: {names[i], names[j]} <= frames.VEHICLES
    operator, clash = {
        "str24": (frames.without_cross_class_duplicates, lambda i, j: (names[i] == names[j] or vehicles(i, j)) and shared[i, j] >= (0.25 if vehicles(i, j) else 0.40)),
        "str25": (frames.without_track_duplicates, lambda i, j: shared[i, j] >= 0.30 or (shared[i, j] > 0.10 and np.hypot(*(centre[i] - centre[j])) < 40)),
        "str26": (frames.nms, lambda i, j: names[i] == names[j] and shared[i, j] > 0.45),
    }[name]
    rows = pd.DataFrame({"f": 0, "id": np.arange(n), "class_name": names, "confidence": scores} | dict(zip(frames.BOX, boxes.T, strict=True)))
    assert sorted(r.id for r in operator(spark.createDataFrame(rows), ["f"]).collect()) == plain(boxes, names, scores, clash)


def test_only_the_best_of_a_frame(spark):
    rows = pd.DataFrame({"f": 0, "id": range(9), "class_name": "car", "confidence": [i / 9 for i in range(9)]} | {c: [100.0 * i + (c in ("x2", "y2")) for i in range(9)] for c in frames.BOX})
    assert sorted(r.id for r in frames.nms(spark.createDataFrame(rows), ["f"], most=4).collect()) == [5, 6, 7, 8]


def test_cheapest_in_bands():
    """bands of costs, halved ones and equal ones give what all costs at once give."""
    for seed in range(40):
        a, b = crowd(30, seed), crowd(25, seed + 1000)
        cost = 1 - frames.overlaps(a, b)
        for most in (0.0, 0.5, 0.8, 1.0):
            wanted = [(i, j, float(cost[i, j])) for i, j in frames.assigned(cost, most)]
            assert all(frames.cheapest(a, b, most, held) == wanted for held in (10**6, 40, 3))


def test_memory_of_a_crowded_frame():
    """ten thousand boxes against as many take far less than the 800 MB of one matrix of their costs."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    frames.cheapest(crowd(10_000, 3) * 4, crowd(10_000, 4) * 4, 0.8)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_ground_truth_of_copies(spark):
    """equal predictions are given out by number, and a better one that is gone leaves the next best."""
    n = 60
    truth, guess = crowd(n, 5), np.concatenate([crowd(n, 6)] * 2)
    shared, wanted = frames.overlaps(truth, guess), []
    for i in range(n):
        j = int(shared[i].argmax())
        found = shared[i, j] >= 0.2
        wanted.append((i, j if found else None))
        if found:
            shared[:, j] = -1
    side = lambda boxes, is_truth: pd.DataFrame({"f": 0, "is_truth": is_truth, "id": range(len(boxes))} | dict(zip(frames.BOX, boxes.T, strict=True)))
    rows = spark.createDataFrame(pd.concat([side(truth, True), side(guess, False)]))
    assert sorted((r.truth_id, r.prediction_id) for r in frames.greedy_ground_truth(rows, ["f"], 0.2).collect()) == wanted


def test_ground_truth_takes_many_frames_in_one_step(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(f), bool(k % 2), int(k), *(float(v) for v in (x, y, x + 60, y + 60))) for f in range(300) for k, (x, y) in enumerate(rng.integers(0, 120, (9, 2)).tolist())]
    df = spark.createDataFrame(rows, "f long, is_truth boolean, id long, x1 double, y1 double, x2 double, y2 double")
    wanted = []
    for f in range(300):
        own = [r for r in rows if r[0] == f]
        free = [r for r in own if not r[1]]
        for t in (r for r in own if r[1]):
            best = max(free, key=lambda g: (frames.overlaps(np.array([t[3:]]), np.array([g[3:]]))[0, 0], -g[2]), default=None)
            part = frames.overlaps(np.array([t[3:]]), np.array([best[3:]]))[0, 0] if best else 0
            wanted.append((f, t[2], best[2] if part >= 0.2 else None))
            free = [g for g in free if part < 0.2 or g is not best]
    monkeypatch.setattr(frames, "overlaps", None)  # one frame at a time isn't what is done
    got = frames.greedy_ground_truth(df, ["f"], 0.2).collect()
    assert sorted((r.f, r.truth_id, r.prediction_id) for r in got) == sorted(wanted)
