"""Identities of observed vectors: a site's gallery folded over its observations in order, and its candidate join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchline.operators import ordered
from watchline.operators.tracking import kind, numbered

#: Camera links that a site may have; the fold holds them, so that their number is checked.
MOST_LINKS = 10_000


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + 1e-9)


def plausibility(links: dict, a: str, b: str, gap: float) -> tuple[bool, float]:
    """Whether a walk between two cameras in so many seconds is plausible, and how much; see scoring.transition_plausibility."""
    if a == b:
        return True, 1.0
    if (a, b) not in links:
        return (gap > 300, 0.25 if gap > 300 else 0.05) if (a, None) in links else (True, 0.70)
    least, most, mean, weight = links[a, b]
    if gap < least * 0.5:
        return False, 0.1
    if gap > most * 2:
        return True, 0.4
    return True, round(min(1.0, max(0.5, 1 - abs(gap - mean) / (most + 1e-6)) * weight), 2)


class Gallery:
    """The identities of one site that aren't forgotten yet, and the local tracks that are linked with them."""

    def __init__(self, threshold: float, margin: float, certain: float, confirm: int, ttl: float, track_ttl: float, window: float, lock: float, links: dict) -> None:
        self.threshold, self.margin, self.certain, self.confirm = threshold, margin, certain, confirm
        self.ttl, self.track_ttl, self.window, self.lock, self.links = ttl, track_ttl, window, lock, links
        self.known: dict[int, dict] = {}
        self.tracks: dict[tuple, dict] = {}
        self.number = 0

    def observed(self, camera: str, track: str, vector: np.ndarray, now: float) -> tuple[int, str, float, float, bool]:
        """Identity, decision, similarity, lead over the next identity, and whether the track's link is confirmed."""
        self.known = {i: g for i, g in self.known.items() if now - g["seen"] <= self.ttl}
        self.tracks = {k: t for k, t in self.tracks.items() if now - t["seen"] <= self.track_ttl}
        t = self.tracks.setdefault((camera, track), {"identity": None, "confirmed": False, "streak": 0})
        t["seen"] = now
        v = unit(vector)
        own = self.known.get(t["identity"])
        if own is not None and (score := float(v @ own["mean"])) >= self.threshold:
            self._link(t, t["identity"], camera, track, vector, now)
            return t["identity"], "continuity", score, 0.0, t["confirmed"]
        best, first, second = None, -1.0, -1.0
        similar = np.stack([g["mean"] for g in self.known.values()]) @ v if self.known else []
        for (i, g), score in zip(self.known.items(), map(float, similar), strict=True):
            gap = now - g["seen"]
            if g["camera"] == camera:
                other = g["locals"].get(camera)
                if other != track and (camera, other) in self.tracks and now - self.tracks[camera, other]["seen"] < self.lock:
                    continue
            if gap > self.window and not (g["camera"] == camera and g["confirmed"]):
                continue
            if g["camera"] != camera:
                plausible, factor = plausibility(self.links, g["camera"], camera, gap)
                if not plausible:
                    continue
                score *= 0.80 + 0.20 * factor
            if own is not None and t["confirmed"] and i != t["identity"] and score < float(v @ own["mean"]) + self.margin:
                continue
            if score > first:
                best, first, second = i, score, first
            elif score > second:
                second = score
        if best is None or first < self.threshold:
            self.number += 1
            self.known[self.number] = {"vectors": [], "confirmed": False, "locals": {}}
            t["identity"], t["streak"] = self.number, 1
            self._seen(self.known[self.number], camera, track, vector, now)
            return self.number, "new", max(first, 0.0), 0.0, t["confirmed"]
        if first - second < self.margin and first < self.certain:
            return best, "ambiguous", first, first - second, t["confirmed"]
        self._link(t, best, camera, track, vector, now)
        return best, "linked", first, first - second, t["confirmed"]

    def _link(self, t: dict, identity: int, camera: str, track: str, vector: np.ndarray, now: float) -> None:
        t["identity"], t["streak"] = identity, t["streak"] + 1
        t["confirmed"] = t["streak"] >= self.confirm
        g = self.known[identity]
        g["confirmed"] |= t["confirmed"]
        self._seen(g, camera, track, vector, now)

    def _seen(self, g: dict, camera: str, track: str, vector: np.ndarray, now: float) -> None:
        g["vectors"] = [*g["vectors"], vector][-16:]
        g["mean"], g["camera"], g["seen"] = unit(np.mean(g["vectors"], axis=0)), camera, now
        g["locals"][camera] = track


def held(links: DataFrame | None) -> dict:
    """Camera links (from_camera, to_camera, min_s, max_s, avg_s, weight) by their cameras; (camera, None) marks those that have any."""
    if links is None:
        return {}
    rows = links.select("from_camera", "to_camera", "min_s", "max_s", "avg_s", "weight").limit(MOST_LINKS + 1).collect()
    if len(rows) > MOST_LINKS:
        raise ValueError(f"more than {MOST_LINKS} camera links")
    return {(r[0], r[1]): tuple(r)[2:] for r in rows} | {(r[0], None): () for r in rows}


def matched(
    df: DataFrame, site: str, camera: str, track: str, ts: str, seq: str, vector: str, links: DataFrame | None = None, threshold: float = 0.62, margin: float = 0.08,
    certain: float = 0.80, confirm: int = 3, ttl: float = 900.0, track_ttl: float = 180.0, window: float = 45.0, lock: float = 8.0,
) -> DataFrame:
    """Observations (``seq``) with ``identity`` (numbered by site), ``decision``, ``score``, ``margin`` and ``confirmed``.

    A track goes on with its identity while it is like it; three matches in a row confirm the link, and a confirmed
    one is left only for an identity that is clearly more alike. Else the best identity within the window is taken
    that isn't another live track's on the same camera and that a walk makes plausible, if it is like enough and leads
    the second, or is near certain; an ambiguous one is named but not linked. Identities are forgotten after ``ttl``
    seconds, and a site's observations are cut where all are. ``ts`` are seconds; rows without them are left out.
    """
    known = held(links)

    def begin(stretch: int):
        gallery = Gallery(threshold, margin, certain, confirm, ttl, track_ttl, window, lock, known)

        def take(now: float | None, rows: list[tuple] | None) -> list[tuple]:
            return [(s, *gallery.observed(c, t, np.asarray(raw, float), float(now)), gallery.number) for c, t, raw, s in rows or []]

        return take

    rows = df.select(*dict.fromkeys([site, camera, track, ts, seq, vector]))
    schema = f"`{seq}` {kind(df, seq)}, track_id long, decision string, score double, margin double, confirmed boolean, _begun long"
    found = ordered.folded(rows, [site], ts, [camera, track, vector, seq], [seq], ttl, begin, schema)
    return numbered(found, site, "_begun").withColumnRenamed("track_id", "identity")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def candidates(observations: DataFrame, gallery: DataFrame, window: float = 45.0, threshold: float = 0.62, margin: float = 0.08, certain: float = 0.80) -> DataFrame:
    """Each observation (seq, site, at, vector) with the best identity (identity, site, seen, mean) that was seen at its
    site up to ``window`` seconds before: ``identity``, ``score``, ``lead`` over the second (null: none), and ``linked``.

    Times are cut into buckets of ``window`` seconds and an identity counts for its own and the next, so that the join is
    an equality on site and bucket. Of equally alike identities the first counts.
    """
    bucket = F.floor(F.col("seen") / window)
    g = gallery.select("site", "identity", "seen", "mean").withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    o = observations.select("seq", "site", "at", "vector").withColumn("bucket", F.floor(F.col("at") / window))
    gap = F.col("at") - F.col("seen")
    pairs = o.join(g, ["site", "bucket"]).where((gap > 0) & (gap <= window)).select("seq", "identity", cosine(F.col("vector"), F.col("mean")).alias("score"))
    w = Window.partitionBy("seq").orderBy(F.desc("score"), "identity")
    ranked = pairs.withColumn("n", F.row_number().over(w)).where("n <= 2")
    top = ranked.groupBy("seq").agg(*(F.max(F.when(F.col("n") == 1, F.col(c))).alias(c) for c in ("identity", "score")), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("second"))
    lead = F.col("score") - F.col("second")
    linked = (F.col("score") >= threshold) & (F.coalesce(lead >= margin, F.lit(True)) | (F.col("score") >= certain))
    return top.select("seq", "identity", "score", lead.alias("lead"), linked.alias("linked"))
