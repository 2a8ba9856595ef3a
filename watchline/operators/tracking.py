"""Tracks from detections: association in bands, re-adoption of lost tracks, and prediction between detections.

The state of a camera is its live tracks. It is handed from frame to frame by ``ordered.together``, for many cameras at once; a
camera's frames are cut where no track can outlive the gap. The filter runs over all tracks of these cameras at once: noise and motion are
the same for each of a box's four measures, so that each has a filter of two numbers of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchline.operators import ordered
from watchline.operators.frames import BOX, common, crossed, shared_by

# Classes of one family; shares of a box's height that the filter's noise has.
FAMILY = {"car", "bus", "truck", "motorcycle", "bicycle", "vehicle"}
PLACE, RATE = 1 / 20, 1 / 160
UNSURE, LIVE, LOST = 0, 1, 2


def measured(boxes: np.ndarray) -> np.ndarray:
    """Centre, aspect and height of boxes."""
    size = boxes[:, 2:] - boxes[:, :2]
    height = np.where(size[:, 1] > 0, size[:, 1], 1.0)
    return np.column_stack([boxes[:, :2] + size / 2, size[:, 0] / height, size[:, 1]])


class Filter:
    """Kalman filters of many boxes: for each of four measures its value, its rate and their covariance."""

    def __init__(self, boxes: np.ndarray) -> None:
        self.value = measured(boxes)
        self.rate = np.zeros_like(self.value)
        place, rate = self.noise(2 * PLACE, 1e-2), self.noise(10 * RATE, 1e-5)
        self.vv, self.vr, self.rr = place, np.zeros_like(place), rate

    def noise(self, share: float, aspect: float) -> np.ndarray:
        h = self.value[:, 3]
        return np.square(np.column_stack([share * h, share * h, np.full(len(h), aspect), share * h]))

    def predict(self, which: np.ndarray, lost: np.ndarray) -> None:
        """One frame on; a lost track's height keeps still."""
        self.rate[which & lost, 3] = 0
        place, rate = self.noise(PLACE, 1e-2), self.noise(RATE, 1e-5)
        w = which[:, None]
        self.value = np.where(w, self.value + self.rate, self.value)
        self.vv = np.where(w, self.vv + 2 * self.vr + self.rr + place, self.vv)
        self.vr = np.where(w, self.vr + self.rr, self.vr)
        self.rr = np.where(w, self.rr + rate, self.rr)

    def update(self, at: np.ndarray, boxes: np.ndarray) -> None:
        seen = self.noise(PLACE, 1e-1)[at]
        off, total = measured(boxes) - self.value[at], self.vv[at] + seen
        gain, drift = self.vv[at] / total, self.vr[at] / total
        self.value[at] += gain * off
        self.rate[at] += drift * off
        self.rr[at] -= drift * self.vr[at]
        self.vr[at] *= 1 - gain
        self.vv[at] *= 1 - gain

    def boxes(self) -> np.ndarray:
        half = np.column_stack([self.value[:, 2] * self.value[:, 3], self.value[:, 3]]) / 2
        return np.concatenate([self.value[:, :2] - half, self.value[:, :2] + half], axis=1)

    def _all(self) -> list[str]:
        return ["value", "rate", "vv", "vr", "rr"]

    def keep(self, at: np.ndarray) -> None:
        for name in self._all():
            setattr(self, name, getattr(self, name)[at])

    def add(self, other: Filter) -> None:
        for name in self._all():
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))


def key(lane: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One number for a lane and a track of it; a lane has fewer than 2^40 tracks."""
    return (lane << 40) + number


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is among ``keys``, -1 for nowhere."""
    if not len(keys):
        return np.full(len(wanted), -1)
    order = np.argsort(keys)
    at = order[np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)]
    return np.where(keys[at] == wanted, at, -1)


class Bands:
    """The tracks of many cameras, a lane each. Sure boxes meet live and lost tracks, unsure ones the live tracks that are left,
    and what is left of the sure ones the tracks of a single sighting; then they begin tracks. What a step doesn't name stays as it is."""

    ARRAYS = ("lane", "ids", "state", "seen", "rank")

    def __init__(self, high: float, low: float, lost: int, match: float) -> None:
        self.high, self.low, self.buffer, self.match = high, low, lost, match
        self.filter = Filter(np.empty((0, 4)))
        self.lane, self.ids, self.state, self.seen, self.rank = (np.empty(0, np.int64) for _ in self.ARRAYS)
        self.frame, self.number, self.first, self.ranks = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), 0

    def open(self, stretches: np.ndarray) -> None:
        none = np.zeros(len(stretches), np.int64)
        self.frame, self.number, self.first = np.concatenate([self.frame, none]), np.concatenate([self.number, none]), np.concatenate([self.first, stretches == 0])

    def keep_lane(self, lane: int) -> None:
        self._keep(self.lane == lane)
        self.lane[:] = 0
        self.frame, self.number, self.first = self.frame[[lane]], self.number[[lane]], self.first[[lane]]

    def here(self, lanes: np.ndarray) -> np.ndarray:
        """Which tracks are of these lanes."""
        some = np.zeros(len(self.frame), bool)
        some[lanes] = True
        return some[self.lane]

    def update(self, lanes: np.ndarray, lane: np.ndarray, boxes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One frame of each of the lanes: the track of each box, and its place, -1 for none. Boxes are sorted by ``lane``."""
        self.frame[lanes] += 1
        named, place = np.full(len(boxes), -1), np.full(len(boxes), -1)
        high = scores > self.high
        here = self.here(lanes)
        self.filter.predict(here & (self.state != UNSURE), self.state == LOST)
        was = np.where(here, self.state, -1)
        free = np.ones(len(self.ids), bool)
        again: list[np.ndarray] = []

        def meet(tracks: np.ndarray, some: np.ndarray, most: float) -> None:
            if not len(tracks) or not len(some):
                return
            found, at = [], self.filter.boxes()[tracks]
            for i, j in crossed(self.lane[tracks], lane[some]):
                cost = 1 - shared_by(at[i], boxes[some[j]])
                near = np.flatnonzero(cost <= most)
                found.append((i[near], j[near], cost[near]))
            i, j, cost = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((j, i, cost, lane[some[j]]))
            rows, columns, pairs = bytearray(len(tracks)), bytearray(len(some)), []
            for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
                if not rows[p] and not columns[q]:
                    rows[p] = columns[q] = 1
                    pairs.append((p, q))
            if pairs:
                p, q = np.array(pairs).T
                t, b = tracks[p], some[q]
                self.filter.update(t, boxes[b])
                self.state[t], self.seen[t], free[t], named[b], place[b] = LIVE, self.frame[self.lane[t]], False, self.ids[t], t
                again.append(t[was[t] == LOST])

        meet(np.concatenate([np.flatnonzero(was == LIVE), np.flatnonzero(was == LOST)]), np.flatnonzero(high), self.match)
        meet(np.flatnonzero(free & (was == LIVE)), np.flatnonzero((scores > self.low) & ~high), 0.5)
        self.state[free & (was == LIVE)] = LOST
        meet(np.flatnonzero(was == UNSURE), np.flatnonzero(high & (named < 0)), 0.7)
        back = np.concatenate([np.empty(0, np.int64), *again])
        over = free & ((was == UNSURE) | ((was == LOST) & (self.frame[self.lane] - self.seen > self.buffer)))
        begun = np.flatnonzero(high & (named < 0))
        if over.any():
            moved = np.cumsum(~over) - 1
            place[place >= 0], back = moved[place[place >= 0]], moved[back]
            self._keep(~over)
        if len(begun):
            own = lane[begun]
            fresh = self.number[own] + 1 + np.arange(len(begun)) - np.searchsorted(own, own)
            np.add.at(self.number, own, 1)
            state = np.where(self.first[own] & (self.frame[own] == 1), LIVE, UNSURE)
            live = begun[state == LIVE]
            named[live], place[live] = fresh[state == LIVE], len(self.ids) + np.flatnonzero(state == LIVE)
            self.filter.add(Filter(boxes[begun]))
            rank = self.ranks + np.arange(len(begun))
            self.ranks += len(begun)
            for name, more in zip(self.ARRAYS, (own, fresh, state, self.frame[own], rank), strict=True):
                setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.last(back)
        return named, place

    def predict(self, lanes: np.ndarray) -> None:
        """All tracks of the lanes one frame on without boxes to meet."""
        self.filter.predict(self.here(lanes), self.state == LOST)

    def adopt(self, at: np.ndarray, boxes: np.ndarray) -> None:
        """Tracks go on with boxes that had begun other ones, which the caller ends."""
        self.filter.update(at, boxes)
        self.last(at[self.state[at] == LOST])
        self.state[at], self.seen[at] = LIVE, self.frame[self.lane[at]]

    def last(self, at: np.ndarray) -> None:
        """Tracks that are found again come after all others in a frame's order."""
        self.rank[at] = self.ranks + np.arange(len(at))
        self.ranks += len(at)

    def _keep(self, at: np.ndarray) -> None:
        self.filter.keep(at)
        for name in self.ARRAYS:
            setattr(self, name, getattr(self, name)[at])


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def numbered(df: DataFrame, camera: str, begun: str) -> DataFrame:
    """Rows of a track, with numbers that go on from stretch to stretch; ``begun`` is how many tracks a stretch began so far."""
    sizes = df.groupBy(camera, ordered.STRETCH).agg(F.max(begun).alias("_n"))
    w = Window.partitionBy(camera).orderBy(ordered.STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(camera, ordered.STRETCH, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return df.where("track_id > 0").join(before, [camera, ordered.STRETCH]).withColumn("track_id", F.col("track_id") + F.col("_before")).drop("_before", ordered.STRETCH, begun)


def renumbered(df: DataFrame, sizes: DataFrame, camera: str) -> DataFrame:
    """Rows with track numbers that go on from stretch to stretch; ``sizes`` has how many tracks (``_begun``) each stretch but a camera's last one began."""
    w = Window.partitionBy(camera).orderBy(ordered.STRETCH)
    before = sizes.select(camera, (F.col(ordered.STRETCH) + 1).alias(ordered.STRETCH), F.sum("_begun").over(w).alias("_before"))
    return df.join(before, [camera, ordered.STRETCH], "left").withColumn("track_id", F.col("track_id") + F.coalesce("_before", F.lit(0))).drop("_before", ordered.STRETCH)


def floats(columns: list[pa.Array]) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])


class Named:
    """For ``ordered.together``: the track of each detection, or (``counted``) only how many tracks each stretch began."""

    def __init__(self, bands: Bands, counted: bool) -> None:
        self.bands, self.counted, self.at = bands, counted, np.empty(0)

    def open(self, stretches: np.ndarray) -> None:
        self.bands.open(stretches)
        self.at = np.concatenate([self.at.astype(float), np.full(len(stretches), np.nan)])

    def step(self, lanes: np.ndarray, at: np.ndarray, lane: np.ndarray, rows: list[pa.Array]) -> Iterator[list]:
        at = at.astype(float)
        missed = np.nan_to_num(at - self.at[lanes], nan=1.0).astype(np.int64) - 1
        self.at[lanes] = at
        for m in range(1, int(missed.max(initial=0)) + 1):
            self.bands.update(lanes[missed >= m], np.empty(0, np.int64), np.empty((0, 4)), np.empty(0))
        named, _ = self.bands.update(lanes, lane, floats(rows[:4]), floats(rows[4:5])[:, 0])
        some = np.flatnonzero(named > 0)
        if not self.counted and len(some):
            yield [lane[some], rows[5].take(pa.array(some)), named[some]]

    def end(self, lanes: np.ndarray) -> Iterator[list]:
        if self.counted:
            yield [lanes, self.bands.number[lanes]]

    def keep(self, lane: int) -> None:
        self.bands.keep_lane(lane)
        self.at = self.at[[lane]]


def tracked(df: DataFrame, camera: str, frame: str, seq: str, high: float = 0.5, low: float = 0.1, lost: int = 30, match: float = 0.8) -> DataFrame:
    """Detections (``seq``) with ``track_id``, numbered by camera; those that belong to no track are left out.

    A track counts from its second sighting in a row on, but for those of a camera's first frame; it is found again
    up to ``lost`` frames later. Frames without rows had no detections. A frame's boxes are taken by confidence, the
    surest first, then by ``seq``.
    """
    rows = df.where(F.col(camera).isNotNull()).select(camera, frame, seq, "confidence", *BOX).withColumn("_less", -F.col("confidence"))

    def found(counted: bool, schema: str) -> DataFrame:
        return ordered.together(rows, [camera], frame, [*BOX, "confidence", seq], ["_less", seq], lost + 1, lambda: Named(Bands(high, low, lost, match), counted), schema, followed=counted)

    return renumbered(found(False, f"`{seq}` {kind(df, seq)}, track_id long"), found(True, "_begun long"), camera)


def filtered(df: DataFrame, keys: list[str], frame: str, seq: str) -> DataFrame:
    """The centre ``x, y`` and its speed ``vx, vy`` as the filter has them after each sighting of a thing (``keys``).

    Sightings are taken in order of ``frame`` and ``seq``, each one step after the last.
    """

    def begin(stretch: int):
        # Of one box plain numbers; its places and its height have the same noise, so that one covariance does for them.
        x = y = h = vx = vy = vh = vv = vr = rr = 0.0
        known = False

        def take(at: int | None, rows: list[tuple] | None) -> list[tuple]:
            nonlocal x, y, h, vx, vy, vh, vv, vr, rr, known
            out = []
            for x1, y1, x2, y2, number in rows or []:
                width, height = float(x2) - float(x1), float(y2) - float(y1)
                at_x, at_y = float(x1) + width / 2, float(y1) + height / 2
                if not known:
                    known, x, y, h = True, at_x, at_y, height
                    vv, rr = (2 * PLACE * h) ** 2, (10 * RATE * h) ** 2
                else:
                    place, rate = (PLACE * h) ** 2, (RATE * h) ** 2
                    x, y, h = x + vx, y + vy, h + vh
                    vv, vr, rr = vv + 2 * vr + rr + place, vr + rr, rr + rate
                    total = vv + (PLACE * h) ** 2
                    gain, drift = vv / total, vr / total
                    off_x, off_y, off_h = at_x - x, at_y - y, height - h
                    x, y, h = x + gain * off_x, y + gain * off_y, h + gain * off_h
                    vx, vy, vh = vx + drift * off_x, vy + drift * off_y, vh + drift * off_h
                    rr, vr, vv = rr - drift * vr, vr * (1 - gain), vv * (1 - gain)
                out.append((at, number, x, y, vx, vy))
            return out

        return take

    schema = f"`{frame}` {kind(df, frame)}, `{seq}` {kind(df, seq)}, x double, y double, vx double, vy double"
    return ordered.folded(df.select(*keys, frame, seq, *BOX), keys, frame, [*BOX, seq], [seq], None, begin, schema).drop(ordered.STRETCH)


def hundredths(v: np.ndarray) -> np.ndarray:
    """Numbers rounded to hundredths as ``round(v, 2)`` does, by the exact product."""
    scaled = v * 100.0
    split = 134217729.0 * v
    high = split - (split - v)
    error = (high * 100.0 - scaled) + (v - high) * 100.0
    whole = np.floor(scaled)
    off = (scaled - whole - 0.5) + error
    return np.copysign((whole + ((off > 0) | ((off == 0) & (whole % 2 == 1)))) / 100.0, v)


def centres(boxes: np.ndarray) -> np.ndarray:
    return hundredths((boxes[:, :2] + boxes[:, 2:]) / 2)


def share(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intersection over union of each box of a with its box of b, and whether they meet at all."""
    width, height, areas = common(a, b)
    return width * height / np.maximum(areas - width * height, 1e-6), (width > 0) & (height > 0)


class Continuity:
    """For ``ordered.together``: tracks as they are shown; lost ones glide on and are adopted again by new ones that turn up on them.

    ``only`` is the provenance of the rows to give; with ``counted`` there is but the number of tracks that each stretch began.
    """

    #: Of each shown track: its lane and number, its box, centre and velocity, whether it moves, frames missed, hits, class, its last
    #: votes, and its last five places with their number.
    ARRAYS = ("lane", "ids", "box", "centre", "velocity", "moves", "missed", "hits", "kind", "votes", "path", "points")

    def __init__(self, bands: Bands, width: float, height: float, stride: int, counted: bool, only: str | None) -> None:
        self.bands, self.size, self.stride, self.counted, self.only = bands, np.array([width, height, width, height]), stride, counted, only
        self.names: dict[str, int] = {"object": 0}
        self.at = np.empty(0, np.int64)
        self._add(np.empty(0, np.int64), np.empty(0, np.int64), first=True)

    def _add(self, lane: np.ndarray, ids: np.ndarray, first: bool = False) -> None:
        n = len(lane)
        none, zeros = np.zeros(n, np.int64), np.zeros((n, 4))
        fresh = (lane, ids, zeros, zeros[:, :2], zeros[:, :2], np.zeros(n, bool), none, none, none, np.full((n, 20), -1, np.int16), np.zeros((n, 5, 2)), none)
        for name, more in zip(self.ARRAYS, fresh, strict=True):
            setattr(self, name, more.copy() if first else np.concatenate([getattr(self, name), more]))

    def _keep(self, at: np.ndarray) -> None:
        for name in self.ARRAYS:
            setattr(self, name, getattr(self, name)[at])

    def here(self, lanes: np.ndarray) -> np.ndarray:
        some = np.zeros(len(self.at), bool)
        some[lanes] = True
        return some[self.lane]

    def open(self, stretches: np.ndarray) -> None:
        self.bands.open(stretches)
        self.at = np.concatenate([self.at, np.full(len(stretches), -1)])

    def keep(self, lane: int) -> None:
        self._keep(self.lane == lane)
        self.lane[:] = 0
        self.bands.keep_lane(lane)
        self.at = self.at[[lane]]

    def moved(self, at: np.ndarray, path: np.ndarray, points: np.ndarray) -> None:
        """Velocity over the last five places, and whether the track moves at all; the last place is the last one of ``path``."""
        known = np.minimum(points, 5)
        n = np.maximum(1, known - 1)
        off = path[:, 4] - path[np.arange(len(at)), 5 - known]
        far = np.hypot(off[:, 0], off[:, 1])
        self.velocity[at], self.moves[at] = hundredths(off / n[:, None]), (known > 1) & (far >= n) & (far > 0)

    def walked(self, at: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last five places with one more, and their number."""
        return np.concatenate([self.path[at][:, 1:], centre[:, None]], axis=1), np.minimum(self.points[at] + 1, 5)

    def seen(self, at: np.ndarray, boxes: np.ndarray, kinds: np.ndarray) -> None:
        """Tracks (each once) meet the filter's boxes of their detections."""
        some = np.flatnonzero(kinds > 0)
        if len(some):
            t, k = at[some], kinds[some]
            votes = self.votes[t]
            votes = np.concatenate([votes[:, 1:], k[:, None].astype(np.int16)], axis=1)
            self.votes[t] = votes
            mixed = np.flatnonzero(((votes != k[:, None]) & (votes >= 0)).any(axis=1))
            self.kind[t] = k
            if len(mixed):
                v = votes[mixed]
                counts = np.where(v >= 0, (v[:, :, None] == v[:, None, :]).sum(axis=2), -1)
                self.kind[t[mixed]] = v[np.arange(len(v)), counts.argmax(axis=1)]
        self.moved(at, *self.walked(at, centres(boxes)))
        alpha = np.where(self.moves[at], 0.4, 0.85)[:, None]
        boxes = np.where((self.hits[at] > 0)[:, None], alpha * self.box[at] + (1 - alpha) * boxes, boxes)
        self.centre[at] = centres(boxes)
        self.path[at], self.points[at] = self.walked(at, self.centre[at])
        self.box[at], self.missed[at] = hundredths(boxes), 0
        self.hits[at] += 1

    def adopted(self, lane: np.ndarray, boxes: np.ndarray, kinds: np.ndarray, lost: np.ndarray) -> np.ndarray:
        """The lost track (of ``lost``, by lane) that each new one's box goes to, -1 for none: the best overlap over 0.20, else the first within 45 pixels."""
        out = np.full(len(lane), -1)
        best = np.full(len(lane), 0.20)
        for i, j in crossed(lane, self.lane[lost]):
            t = lost[j]
            a, b = kinds[i], self.kind[t]
            family = np.array([n in FAMILY for n in self.names])
            alike = (a == b) | (a == 0) | (b == 0) | (family[a] & family[b])
            i, t = i[alike], t[alike]
            part, meets = share(boxes[i], self.box[t])
            off = (boxes[i, :2] + boxes[i, 2:]) / 2 - self.centre[t]
            close = np.flatnonzero(~meets & (np.hypot(off[:, 0], off[:, 1]) < 45))
            # Later chunks go on with the same row; pairs are in the tracks' order.
            near = close[np.unique(i[close], return_index=True)[1]]
            near = near[out[i[near]] < 0]
            out[i[near]] = t[near]
            over = np.flatnonzero(meets & (part > 0.20))
            over = over[np.lexsort((over, -part[over], i[over]))]
            over = over[np.unique(i[over], return_index=True)[1]]
            over = over[part[over] > best[i[over]]]
            out[i[over]], best[i[over]] = t[over], part[over]
        return out

    def detected(self, lanes: np.ndarray, frame: np.ndarray, lane: np.ndarray, boxes: np.ndarray, scores: np.ndarray, kinds: np.ndarray) -> Iterator[list]:
        """Rows of a frame with detections, ``frame`` that of each of the lanes: as ``row`` gives them, the place of the box first (-1: none)."""
        bands = self.bands
        named, place = bands.update(lanes, lane, boxes, scores)
        rows = np.flatnonzero(named > 0)
        rows = rows[np.lexsort((bands.rank[place[rows]], lane[rows]))]
        place, own, number, met = place[rows], lane[rows], named[rows], bands.filter.boxes()[place[rows]]
        at = places(key(self.lane, self.ids), key(own, number))
        here = self.here(lanes)
        taken = np.zeros(len(self.ids), bool)
        # Where no track is lost, those that are new or seen again don't wait for each other.
        lost = here & (self.missed > 0) & (self.missed <= bands.buffer)
        some = np.zeros(len(self.at), bool)
        some[self.lane[lost]] = True
        waits = np.where(at < 0, some[own], self.missed[np.maximum(at, 0)] > 0) if len(self.ids) else np.zeros(len(rows), bool)
        ended = np.zeros(len(bands.ids), bool)

        def meet(which: np.ndarray) -> Iterator[list]:
            nonlocal taken
            fresh = which[at[which] < 0]
            if len(fresh):
                at[fresh] = len(self.ids) + np.arange(len(fresh))
                self._add(own[fresh], number[fresh])
                taken = np.concatenate([taken, np.ones(len(fresh), bool)])
            taken[at[which]] = True
            self.seen(at[which], met[which], kinds[rows[which]])
            if self.only != "prediction" and not self.counted and len(which):
                yield self.row(at[which], rows[which], frame[np.searchsorted(lanes, own[which])], "detection")

        yield from meet(np.flatnonzero(~waits))
        waiting = np.flatnonzero(waits)
        if len(waiting):
            candidates = np.flatnonzero(lost)
            candidates = candidates[np.argsort(self.lane[candidates], kind="stable")]
            turn = np.arange(len(waiting)) - np.searchsorted(own[waiting], own[waiting])
            by_turn = waiting[np.argsort(turn, kind="stable")]
            bounds = np.searchsorted(np.sort(turn), np.arange(turn.max() + 2))
            for k, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                which = by_turn[k:end]
                new = which[at[which] < 0]
                old = self.adopted(own[new], met[new], kinds[rows[new]], candidates[~taken[candidates]])
                new, old = new[old >= 0], old[old >= 0]
                if len(new):
                    at[new] = old
                    ended[place[new]] = True
                    there = places(key(bands.lane, bands.ids), key(own[new], self.ids[old]))
                    bands.adopt(there[there >= 0], met[new][there >= 0])
                yield from meet(which)
        if ended.any():
            bands._keep(~ended)
        yield from self.glided(lanes, frame, taken)

    def row(self, at: np.ndarray, place: np.ndarray, frame: np.ndarray, how: str) -> list:
        return [self.lane[at], frame, place, self.ids[at], how, self.hits[at], self.missed[at], self.kind[at], self.box[at]]

    def missed_again(self, at: np.ndarray) -> np.ndarray:
        """Tracks ``at`` are missed once more: those that are still shown, once the others are gone."""
        self.missed[at] += 1
        gone = np.zeros(len(self.ids), bool)
        gone[at] = self.missed[at] > self.bands.buffer
        left = np.zeros(len(self.ids), bool)
        left[at] = True
        if gone.any():
            self._keep(~gone)
        return np.flatnonzero(left[~gone])

    def glided(self, lanes: np.ndarray, frame: np.ndarray, taken: np.ndarray) -> Iterator[list]:
        """Rows of the tracks that this frame has missed, where no seen track is in their place."""
        # Tracks begun in this frame are taken too.
        live = np.flatnonzero(taken)
        live_lane, live_box = self.lane[live], self.box[live]
        by_lane = np.argsort(live_lane, kind="stable")
        live_lane, live_box = live_lane[by_lane], live_box[by_lane]
        at = self.missed_again(np.flatnonzero(self.here(lanes) & ~taken))
        v = self.velocity[at]
        still = (np.abs(v) < 1).all(axis=1)
        fade = np.array([0.5 ** (m / (self.bands.buffer * 0.5)) if m else 1.0 for m in range(self.bands.buffer + 1)])[self.missed[at]] if self.bands.buffer else np.ones(len(at))
        v = np.where(still[:, None], 0.0, np.clip(v * fade[:, None], -25.0, 25.0))
        boxes = self.clipped(self.box[at] + np.concatenate([v, v], axis=1))
        self.box[at], self.centre[at] = hundredths(boxes), centres(boxes)
        if self.only == "detection" or self.counted or not len(at):
            return
        hidden = np.zeros(len(at), bool)
        for i, j in crossed(self.lane[at], live_lane):
            part, meets = share(self.box[at][i], live_box[j])
            hidden[i[meets & (part > 0.55)]] = True
        at = at[~hidden]
        yield self.row(at, np.full(len(at), -1), frame[np.searchsorted(lanes, self.lane[at])], "prediction")

    def clipped(self, boxes: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, np.minimum(self.size, boxes)) + 0.0

    def predicted(self, lanes: np.ndarray, frame: np.ndarray) -> Iterator[list]:
        """Rows of a frame in which nothing was looked for: every track one frame on."""
        self.bands.predict(lanes)
        at = self.missed_again(np.flatnonzero(self.here(lanes)))
        if not len(at):
            return
        there = places(key(self.bands.lane, self.bands.ids), key(self.lane[at], self.ids[at]))
        v = np.clip(self.velocity[at], -50.0, 50.0)
        boxes = self.box[at] + np.concatenate([v, v], axis=1)
        known = np.flatnonzero(there >= 0)
        boxes[known] = self.bands.filter.boxes()[there[known]]
        boxes = self.clipped(boxes)
        self.centre[at] = centres(boxes)
        self.path[at], self.points[at] = self.walked(at, self.centre[at])
        self.moved(at, self.path[at], self.points[at])
        self.box[at] = hundredths(boxes)
        if self.only != "detection" and not self.counted:
            yield self.row(at, np.full(len(at), -1), frame[np.searchsorted(lanes, self.lane[at])], "prediction")

    def between(self, lanes: np.ndarray, n: np.ndarray) -> Iterator[list]:
        """Rows of the ``n`` frames of each lane after its last one."""
        for m in range(1, int(n.max(initial=0)) + 1):
            some = lanes[n >= m]
            frame = self.at[some] + m
            looked = frame % self.stride == 0
            if not looked.all():
                yield from self.predicted(some[~looked], frame[~looked])
            if looked.any():
                yield from self.detected(some[looked], frame[looked], np.empty(0, np.int64), np.empty((0, 4)), np.empty(0), np.empty(0, np.int64))

    def written(self, found: list, seq: pa.Array | None) -> list:
        lane, frame, place, ids, how, hits, missed, kinds, box = found
        names = pa.array(list(self.names))
        own = pa.nulls(len(lane), self.seq) if seq is None else seq.take(pa.array(place, mask=place < 0))
        return [lane, frame, own, ids, pa.array([how]).take(pa.array(np.zeros(len(lane), np.int64))), hits.astype(np.int32), missed.astype(np.int32), names.take(pa.array(kinds)), *box.T]

    def step(self, lanes: np.ndarray, at: np.ndarray, lane: np.ndarray, rows: list[pa.Array]) -> Iterator[list]:
        self.seq = rows[5].type
        begun = self.bands.frame[lanes] > 0
        for found in self.between(lanes[begun], (at - self.at[lanes] - 1)[begun]):
            yield self.written(found, None)
        self.at[lanes] = at
        texts = rows[6].dictionary_encode()
        codes = np.array([self.names.setdefault(n or "object", len(self.names)) for n in texts.dictionary.to_pylist()] + [0])
        kinds = codes[texts.indices.fill_null(len(codes) - 1).to_numpy()]
        for found in self.detected(lanes, at, lane, floats(rows[:4]), floats(rows[4:5])[:, 0], kinds):
            yield self.written(found, rows[5])

    def end(self, lanes: np.ndarray) -> Iterator[list]:
        if self.counted:
            yield [lanes, self.bands.number[lanes]]
        elif self.only != "detection" and len(lanes):
            for found in self.between(lanes, np.full(len(lanes), self.bands.buffer)):
                yield self.written(found, None)


def continued(
    df: DataFrame, camera: str, frame: str, seq: str, high: float = 0.08, low: float = 0.1, lost: int = 60, match: float = 0.82, stride: int = 1, width: float = 1280.0, height: float = 720.0, only: str | None = None
) -> DataFrame:
    """``seq`` (null for predictions), ``frame``, ``track_id``, ``provenance``, ``hits``, ``missed``, ``object_class`` and the shown
    box of every track in every frame, by camera.

    New tracks on a lost one of the same family take its number. Between detections tracks are predicted: frames that
    ``stride`` doesn't divide and that have no rows weren't looked at; other frames without rows had no detections. A
    track is shown up to ``lost`` frames after it was last seen, also beyond a camera's last row. A missing class counts
    as ``object``, which is of any family. Lost tracks are kept for ``lost`` frames that were looked at. Rows without a frame, or whose box has no area, are left out.
    ``only`` names the provenance of the rows wanted, else both.
    """

    rows = df.select(camera, F.col(frame).cast("long").alias(frame), seq, "confidence", "class_name", *BOX).where("x2 > x1 AND y2 > y1").where(F.col(camera).isNotNull()).withColumn("_less", -F.col("confidence"))
    schema = f"`{frame}` long, `{seq}` {kind(df, seq)}, track_id long, provenance string, hits int, missed int, object_class string, x1 double, y1 double, x2 double, y2 double"

    def found(counted: bool, schema: str) -> DataFrame:
        begin = lambda: Continuity(Bands(high, low, lost, match), width, height, stride, counted, only)
        return ordered.together(rows, [camera], frame, [*BOX, "confidence", seq, "class_name"], ["_less", seq], (lost + 1) * stride, begin, schema, followed=counted)

    return renumbered(found(False, schema), found(True, "_begun long"), camera)
