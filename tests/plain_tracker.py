"""Tracking written out plainly, one track and one matrix at a time, to compare the operators with."""

import math
from collections import Counter

import numpy as np

STEP = np.eye(8) + np.diag(np.ones(4), 4)
FAMILY = {"car", "bus", "truck", "motorcycle", "bicycle", "vehicle"}


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def xyah(b):
    return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / (b[3] - b[1]), b[3] - b[1]])


class Track:
    def __init__(self, number, box, frame):
        self.id, self.state, self.seen = number, "unsure", frame
        self.mean = np.concatenate([xyah(box), np.zeros(4)])
        h = self.mean[3]
        self.cov = np.diag(np.square([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]))

    def predict(self):
        if self.state == "lost":
            self.mean[7] = 0
        h = self.mean[3]
        self.mean = STEP @ self.mean
        self.cov = STEP @ self.cov @ STEP.T + np.diag(np.square([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]))

    def update(self, box, frame):
        h = self.mean[3]
        noise = np.diag(np.square([h / 20, h / 20, 1e-1, h / 20]))
        gain = self.cov[:, :4] @ np.linalg.inv(self.cov[:4, :4] + noise)
        self.mean = self.mean + gain @ (xyah(box) - self.mean[:4])
        self.cov = self.cov - gain @ (self.cov[:4, :4] + noise) @ gain.T
        self.state, self.seen = "live", frame

    def box(self):
        x, y, a, h = self.mean[:4]
        return [x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2]


class Tracker:
    def __init__(self, high, lost, match):
        self.high, self.lost, self.match = high, lost, match
        self.tracks, self.frame, self.n = [], 0, 0

    def meet(self, tracks, boxes, left, most):
        costs = sorted((1 - iou(t.box(), boxes[j]), i, j) for i, t in enumerate(tracks) for j in left)
        used, found = set(), []
        for cost, i, j in costs:
            if cost <= most and i not in used and j in left:
                used.add(i)
                left.remove(j)
                found.append((tracks[i], j))
        for t, j in found:
            t.update(boxes[j], self.frame)
        return found

    def update(self, boxes, scores):
        self.frame += 1
        for t in self.tracks:
            if t.state != "unsure":
                t.predict()
        live, gone, unsure = ([t for t in self.tracks if t.state == s] for s in ("live", "lost", "unsure"))
        sure = [j for j, s in enumerate(scores) if s > self.high]
        weak = [j for j, s in enumerate(scores) if 0.1 < s <= self.high]
        found = self.meet(live + gone, boxes, sure, self.match)
        again = [t for t, _ in found if t in gone]
        met = {t for t, _ in found}
        second = self.meet([t for t in live if t not in met], boxes, weak, 0.5)
        met |= {t for t, _ in second}
        for t in live:
            if t not in met:
                t.state = "lost"
        third = self.meet(unsure, boxes, sure, 0.7)
        met |= {t for t, _ in third}
        begun = []
        for j in sure:
            self.n += 1
            begun.append((Track(self.n, boxes[j], self.frame), j))
            if self.frame == 1:
                begun[-1][0].state = "live"
        kept = [t for t in self.tracks if t in met or (t.state == "lost" and self.frame - t.seen <= self.lost)]
        self.tracks = [t for t in kept if t not in again] + [t for t, _ in begun] + again
        out = {t: j for t, j in [*found, *second, *third, *begun] if t.state == "live"}
        return [(t, out[t]) for t in self.tracks if t in out]


def velocity(path):
    p = path[-5:]
    if len(p) < 2:
        return (0.0, 0.0), False
    n, dx, dy = len(p) - 1, p[-1][0] - p[0][0], p[-1][1] - p[0][1]
    far = math.hypot(dx, dy)
    return (round(dx / n, 2), round(dy / n, 2)), far >= n


def middle(b):
    return round((b[0] + b[2]) / 2, 2), round((b[1] + b[3]) / 2, 2)


def clip(b, w=1280.0, h=720.0):
    return [max(0.0, min(m, v)) for v, m in zip(b, (w, h, w, h), strict=True)]


def continued(frames, high, lost, match, stride):
    """``frames``: {number: [(seq, box, score, class)], ...}; rows of every frame up to ``lost`` beyond the last."""
    tracker, shown, out = Tracker(high, lost, match), {}, []
    for f in range(min(frames), max(frames) + lost + 1):
        if f not in frames and f % stride:
            for t in tracker.tracks:
                t.predict()
            boxes = {t.id: t.box() for t in tracker.tracks}
            for k, s in list(shown.items()):
                s["missed"] += 1
                if s["missed"] > lost:
                    del shown[k]
                    continue
                dx, dy = (max(-50.0, min(50.0, v)) for v in s["v"])
                box = clip(boxes.get(k, [s["box"][0] + dx, s["box"][1] + dy, s["box"][2] + dx, s["box"][3] + dy]))
                s["path"].append(middle(box))
                s["v"], s["moves"] = velocity(s["path"])
                s["c"], s["box"] = middle(box), [round(float(v), 2) for v in box]
                out.append((None, f, k, "prediction", s["hits"], s["missed"], s["class"], *s["box"]))
            continue
        rows = frames.get(f, [])
        taken = set()
        for t, j in tracker.update([r[1] for r in rows], [r[2] for r in rows]):
            name, box, k = rows[j][3] or "object", t.box(), t.id
            if k not in shown:
                best, most = None, 0.0
                for old, s in shown.items():
                    alike = s["class"] == name or "object" in (s["class"], name) or {s["class"], name} <= FAMILY
                    if old in taken or not 0 < s["missed"] <= lost or not alike:
                        continue
                    part = iou(box, s["box"])
                    if part > 0:
                        if part > 0.2 and part > most:
                            best, most = old, part
                    elif best is None and math.dist(((box[0] + box[2]) / 2, (box[1] + box[3]) / 2), s["c"]) < 45:
                        best = old
                if best is not None:
                    k = best
                    old = next((x for x in tracker.tracks if x.id == best), None)
                    if old is not None:
                        was = old.state
                        old.update(box, tracker.frame)
                        if was == "lost":
                            tracker.tracks.remove(old)
                            tracker.tracks.append(old)
                    tracker.tracks.remove(t)
            s = shown.setdefault(k, {"votes": [], "path": [], "hits": 0, "box": None, "class": "object"})
            if name != "object":
                s["votes"] = [*s["votes"], name][-20:]
                s["class"] = Counter(s["votes"]).most_common(1)[0][0]
            s["v"], s["moves"] = velocity([*s["path"], middle(box)])
            if s["box"]:
                a = 0.4 if s["moves"] else 0.85
                box = [a * p + (1 - a) * q for p, q in zip(s["box"], box, strict=True)]
            s["c"] = middle(box)
            s["path"].append(s["c"])
            s.update(box=[round(v, 2) for v in box], missed=0, hits=s["hits"] + 1)
            taken.add(k)
            out.append((rows[j][0], f, k, "detection", s["hits"], 0, s["class"], *s["box"]))
        for k, s in list(shown.items()):
            if k in taken:
                continue
            s["missed"] += 1
            if s["missed"] > lost:
                del shown[k]
                continue
            dx, dy = s["v"]
            fade = 0.0 if abs(dx) < 1 and abs(dy) < 1 else 0.5 ** (s["missed"] / (lost * 0.5))
            dx, dy = (max(-25.0, min(25.0, v * fade)) for v in (dx, dy))
            box = clip([s["box"][0] + dx, s["box"][1] + dy, s["box"][2] + dx, s["box"][3] + dy])
            s["box"], s["c"] = [round(v, 2) for v in box], middle(box)
            if not any(iou(box, shown[o]["box"]) > 0.55 for o in taken):
                out.append((None, f, k, "prediction", s["hits"], s["missed"], s["class"], *s["box"]))
    return out
