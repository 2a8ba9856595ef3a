import random

import numpy as np
import pytest

from watchline.operators import evidence, identities

SCHEMA = "site long, camera string, track string, at double, seq long, v array<double>"


def cosine(a, b):
    return float(np.dot(a, b) / ((np.linalg.norm(a) + 1e-9) * (np.linalg.norm(b) + 1e-9)))


def plain(rows, links, ttl=900.0):
    """The decisions written out plainly over one site's rows in order."""
    known, tracks, n, out = [], {}, 0, []
    for cam, track, now, seq, v in rows:
        known = [g for g in known if now - g["seen"] <= ttl]
        for k in [k for k, t in tracks.items() if now - t["seen"] > 180]:
            del tracks[k]
        t = tracks.setdefault((cam, track), {"id": None, "ok": False, "streak": 0})
        t["seen"] = now
        mean = lambda g: np.mean(g["v"][-16:], axis=0)

        def link(g, t=t, cam=cam, track=track, now=now, v=v):
            t["id"], t["streak"] = g["id"], t["streak"] + 1
            t["ok"] = t["streak"] >= 3
            g["ok"] = g["ok"] or t["ok"]
            g["v"].append(v)
            g["cam"], g["seen"] = cam, now
            g["local"][cam] = track

        own = next((g for g in known if g["id"] == t["id"]), None)
        if own and cosine(v, mean(own)) >= 0.62:
            link(own)
            out.append((seq, own["id"], "continuity", t["ok"]))
            continue
        best, first, second = None, -1.0, -1.0
        for g in known:
            gap, score = now - g["seen"], cosine(v, mean(g))
            if g["cam"] == cam:
                other = g["local"].get(cam)
                if other != track and (cam, other) in tracks and now - tracks[cam, other]["seen"] < 8:
                    continue
            if gap > 45 and not (g["cam"] == cam and g["ok"]):
                continue
            if g["cam"] != cam:
                if (g["cam"], cam) in links:
                    low, high, avg, weight = links[g["cam"], cam]
                    if gap < low / 2:
                        continue
                    factor = 0.4 if gap > 2 * high else round(min(1.0, max(0.5, 1 - abs(gap - avg) / (high + 1e-6)) * weight), 2)
                elif any(a == g["cam"] for a, _ in links):
                    continue
                else:
                    factor = 0.7
                score *= 0.8 + 0.2 * factor
            if own and t["ok"] and g is not own and score < cosine(v, mean(own)) + 0.08:
                continue
            if score > first:
                best, first, second = g, score, first
            elif score > second:
                second = score
        if best is None or first < 0.62:
            n += 1
            g = {"id": n, "v": [v], "ok": False, "local": {cam: track}, "cam": cam, "seen": now}
            known.append(g)
            t["id"], t["streak"] = n, 1
            out.append((seq, n, "new", t["ok"]))
        elif first - second < 0.08 and first < 0.8:
            out.append((seq, best["id"], "ambiguous", t["ok"]))
        else:
            link(best)
            out.append((seq, best["id"], "linked", t["ok"]))
    return out


def walks(rng, site, n):
    """People seen by cameras in turn, under local tracks that change now and then; some long pauses."""
    people = [rng.normal(size=6) for _ in range(5)]
    people.append(people[0] + 0.5 * rng.normal(size=6))
    rows, at = [], 0.0
    for i in range(n):
        at += float(rng.choice([1, 2, 5, 30, 1000], p=[0.4, 0.3, 0.2, 0.09, 0.01]))
        p = int(rng.integers(len(people)))
        v = people[p] + rng.choice([0.1, 0.6]) * rng.normal(size=6)
        rows.append((site, f"C{(i // 9 + p) % 4}", f"T{p}-{i // 25}", at, i, v.tolist()))
    return rows


@pytest.mark.parametrize("size", [1, 13, 10000])
def test_identities_against_a_plain_model(spark, size):
    rows = [r for site in range(3) for r in walks(np.random.default_rng(site), site, 300)]
    links = [("C0", "C1", 1.0, 20.0, 5.0, 0.9), ("C1", "C2", 2.0, 30.0, 10.0, 1.0), ("C1", "C0", 1.0, 20.0, 5.0, 0.9)]
    edges = spark.createDataFrame(links, "from_camera string, to_camera string, min_s double, max_s double, avg_s double, weight double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = identities.matched(spark.createDataFrame(rows, SCHEMA), "site", "camera", "track", "at", "seq", "v", links=edges).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    kinds = set()
    for site in range(3):
        expected = plain([(c, t, at, s, np.array(v)) for where, c, t, at, s, v in rows if where == site], {(a, b): tuple(x) for a, b, *x in links})
        assert sorted((r.seq, r.identity, r.decision, r.confirmed) for r in got if r.site == site) == expected
        kinds |= {(d, ok) for _, _, d, ok in expected}
    assert {d for d, _ in kinds} == {"new", "continuity", "linked", "ambiguous"} and ("continuity", True) in kinds


def test_evidence_limits_of_tracks_and_frames(spark):
    rng = random.Random(4)
    rows = [(cam, f, f"T{rng.randrange(6)}", 0) for cam in range(3) for f in sorted(rng.sample(range(400), 120)) for _ in range(rng.randrange(1, 6))]
    rows = [(*r[:3], i) for i, r in enumerate(rows)]
    want = {}
    last, frame, spent = {}, None, 0
    for cam, f, t, s in rows:
        if (cam, f) != frame:
            frame, spent = (cam, f), 0
        if spent >= 3:
            want[s] = (None, None)
            continue
        before = last.get((cam, t))
        kind, source = ("reused", before[1]) if before and f - before[0] < 15 else ("fresh", s)
        spent += 1 if kind == "fresh" else 2
        last[cam, t] = (f, source)
        want[s] = (kind, source)
    got = evidence.attached(spark.createDataFrame(rows, "cam long, f long, t string, s long"), "cam", "f", "t", "s").collect()
    assert {r.s: (r.evidence, r.source) for r in got} == want and {k for k, _ in want.values()} == {"fresh", "reused", None}
    assert evidence.attached(spark.createDataFrame([], "cam long, f long, t string, s long"), "cam", "f", "t", "s").collect() == []
