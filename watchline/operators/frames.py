"""Greedy operators within a frame, on one frame's rows: memory grows with a frame's rows, not with its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchline.operators import ordered

BOX = ["x1", "y1", "x2", "y2"]
VEHICLES = {"car", "truck", "bus", "van", "motorcycle"}


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of a with every box of b."""
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.prod(np.clip(high - low, 0, None), axis=2)
    area = lambda v: np.prod(v[:, 2:] - v[:, :2], axis=1)
    union = area(a)[:, None] + area(b)[None, :] - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)


def crossed(left: np.ndarray, right: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of equal lanes, left ones in order, up to some ``most`` at a time; ``right`` is sorted."""
    begin = np.searchsorted(right, left)
    count = np.searchsorted(right, left, "right") - begin
    total = np.cumsum(count)
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = count[at:end]
        before = np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(np.arange(at, end), n), np.arange(n.sum()) - before + np.repeat(begin[at:end], n)
        at = end


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Width, height of what each box of a has in common with its box of b, and both areas."""
    low, high = np.maximum(a[:, :2], b[:, :2]), np.minimum(a[:, 2:], b[:, 2:])
    area = lambda v: (v[:, 2] - v[:, 0]) * (v[:, 3] - v[:, 1])
    return high[:, 0] - low[:, 0], high[:, 1] - low[:, 1], area(a) + area(b)


def shared_by(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of a with its box of b, as ``overlaps`` has it."""
    width, height, areas = common(a, b)
    shared = np.clip(width, 0, None) * np.clip(height, 0, None)
    union = areas - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)


def per_frame(df: DataFrame, frame: list[str], clashes, score: str = "confidence", most: int | None = None) -> DataFrame:
    """Rows of each frame, of the best ``most``, without those that clash with a better one; equals are taken in order of their columns.

    ``clashes(columns, i, others)`` tells which of the rows ``others`` clash with row ``i``: only a row that is kept is compared, and
    only with rows that are still there, so that a frame costs no more memory than its rows.
    """
    ties = [c for c in df.columns if c != score and c not in frame]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, *ties], ascending=[False, *([True] * len(ties))], kind="stable", ignore_index=True).head(most if most is not None else len(pdf))
        boxes, names = pdf[BOX].to_numpy(float), pdf["class_name"].to_numpy() if "class_name" in pdf else None
        left, kept = np.arange(len(pdf)), []
        while len(left):
            i, left = left[0], left[1:]
            kept.append(i)
            left = left[~clashes(boxes, names, i, left)]
        return pdf.iloc[kept]

    return df.groupBy(*frame).applyInPandas(run, df.schema)


def nms(df: DataFrame, frame: list[str], threshold: float = 0.45, most: int = 300) -> DataFrame:
    """Non-maximum suppression by class, among the best ``most`` boxes of a frame."""

    def clashes(boxes: np.ndarray, names: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        return (overlaps(boxes[i : i + 1], boxes[others])[0] > threshold) & (names[others] == names[i])

    return per_frame(df, frame, clashes, most=most)


def without_cross_class_duplicates(df: DataFrame, frame: list[str], threshold: float = 0.40, vehicles: float = 0.25) -> DataFrame:
    """One detection of each object: of two that overlap, the surer one; two vehicle classes overlap sooner."""

    def clashes(boxes: np.ndarray, names: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        vehicle = np.isin(names[others], list(VEHICLES)) & (names[i] in VEHICLES)
        shared = overlaps(boxes[i : i + 1], boxes[others])[0]
        return (shared >= np.where(vehicle, vehicles, threshold)) & ((names[others] == names[i]) | vehicle)

    return per_frame(df, frame, clashes)


def without_track_duplicates(df: DataFrame, frame: list[str]) -> DataFrame:
    """One track of each object: those with near centres that overlap, or that overlap by 0.30, are one."""

    def clashes(boxes: np.ndarray, names: np.ndarray | None, i: int, others: np.ndarray) -> np.ndarray:
        off = ((boxes[others, :2] + boxes[others, 2:]) - (boxes[i, :2] + boxes[i, 2:])) / 2
        shared = overlaps(boxes[i : i + 1], boxes[others])[0]
        return ((np.hypot(*off.T) < 40) & (shared > 0.10)) | (shared >= 0.30)

    return per_frame(df, frame, clashes)


def coordinated_groups(df: DataFrame, frame: list[str], near: float = 400.0, alike: float = 0.70) -> DataFrame:
    """Groups of tracks that move together: each track not yet in a group gathers those near it and alike.

    Members are compared with the group's first track only, in the order of the rows' ``track_id``.
    """
    names = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in frame)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.hypot(pdf.vx, pdf.vy) >= 0.5].sort_values("track_id").reset_index(drop=True)
        used: set[int] = set()
        out = []
        for i, seed in pdf.iterrows():
            if i in used:
                continue
            speed = np.hypot(pdf.vx, pdf.vy) * np.hypot(seed.vx, seed.vy)
            cosine = np.where(speed > 1e-8, (pdf.vx * seed.vx + pdf.vy * seed.vy) / speed.where(speed > 1e-8, 1), 0)
            member = (np.hypot(pdf.x - seed.x, pdf.y - seed.y) <= near) & (cosine >= alike) & ~pdf.index.isin(list(used)) & (pdf.index > i)
            group = [i, *pdf.index[member]]
            if len(group) >= 2:
                used |= set(group)
                out.append({**{c: seed[c] for c in frame}, "n_tracks": len(group), "tracks": [str(pdf.track_id[j]) for j in group]})
        return pd.DataFrame(out, columns=[*frame, "n_tracks", "tracks"])

    return df.groupBy(*frame).applyInPandas(run, f"{names}, n_tracks int, tracks array<string>")


def assigned(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs of rows and columns, the cheapest first, of a cost up to ``most``."""
    pairs, rows, columns = [], set(), set()
    near = np.flatnonzero(cost <= most)
    if len(near) > 1:
        near = near[np.argsort(cost.ravel()[near], kind="stable")]
    for flat in near.tolist():
        i, j = divmod(flat, cost.shape[1])
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            pairs.append((i, j))
    return pairs


#: Costs of a frame's pairs that are held at a time.
HELD = 1_000_000


def cheapest(a: np.ndarray, b: np.ndarray, most: float, held: int = HELD) -> list[tuple[int, int, float]]:
    """What ``assigned`` gives for the cost of one less the overlap, and that cost, without all costs at once.

    Costs are taken in bands from the lowest up, each of those boxes that are still free. A band of more than ``held`` pairs
    is cut between its least and its largest cost; one of equal costs is gone through row by row.
    """
    rows, columns = np.arange(len(a)), np.arange(len(b))
    out: list[tuple[int, int, float]] = []
    wide = max(np.abs(v[:, 2] - v[:, 0]).max(initial=0.0) for v in (a, b))

    def blocks(low: float, high: float, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of free boxes with a cost over ``low`` up to ``high``; boxes of a cost under 1 begin less than its share of a width apart."""
        reach = high * wide + 1e-6 if high < 1 else np.inf
        some, others = rows[np.argsort(a[rows, 0], kind="stable")], columns[np.argsort(b[columns, 0], kind="stable")]
        for k in range(0, len(some), step):
            i = some[k : k + step]
            j = others[np.searchsorted(b[others, 0], a[i[0], 0] - reach) : np.searchsorted(b[others, 0], a[i[-1], 0] + reach, "right")]
            for part in range(0, len(j), 4096):
                cost = 1 - overlaps(a[i], b[j[part : part + 4096]])
                p, q = np.nonzero((cost > low) & (cost <= high))
                yield i[p], j[part + q], cost[p, q]

    def by_rows(low: float, high: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in rows:
            cost = 1 - overlaps(a[i : i + 1], b[columns])[0]
            at = np.flatnonzero((cost > low) & (cost <= high))
            yield np.full(len(at), i), columns[at], cost[at]

    bands = [(-np.inf, most)] if len(a) * len(b) <= held else [(most * (k - 1) / 8 if k else -np.inf, most * k / 8) for k in range(8, -1, -1)]
    while bands and len(rows) and len(columns):
        low, high = bands.pop()
        found, n, least, largest = [], 0, np.inf, -np.inf
        for block in blocks(low, high):
            n += len(block[2])
            least, largest = min(least, block[2].min(initial=np.inf)), max(largest, block[2].max(initial=-np.inf))
            found = [*found, block] if n <= held else []
        if n > held and least < largest:
            middle = (least + largest) / 2
            middle = middle if middle < largest else least
            bands += [(middle, high), (low, middle)]
            continue
        if not n:
            continue
        if n <= held:
            i, j, cost = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((j, i, cost))
            found = [(i[order], j[order], cost[order])]
        used, taken = set(), set()
        for i, j, cost in found if n <= held else by_rows(low, high):
            for at in range(len(cost)):
                if i[at] not in used and j[at] not in taken:
                    used.add(i[at])
                    taken.add(j[at])
                    out.append((int(i[at]), int(j[at]), float(cost[at])))
        rows, columns = rows[~np.isin(rows, list(used))], columns[~np.isin(columns, list(taken))]
    return out


def assignments(df: DataFrame, frame: list[str], most: float = 0.8) -> DataFrame:
    """Pairs of a frame's tracks (``is_track``) and its other boxes, the cheapest first, each once: ``track_id, box_id, cost``.

    The cost is one less the overlap, up to ``most``; of equal costs the one of the lower ids comes first.
    """

    def begin(stretch: int):
        def take(at: int | None, rows: list[tuple] | None) -> list[tuple]:
            tracks, others = ([r for r in rows or [] if r[0] is side] for side in (True, False))
            if not tracks or not others:
                return []
            near, far = (np.array([r[2:] for r in side], float) for side in (tracks, others))
            return [(tracks[i][1], others[j][1], cost) for i, j, cost in cheapest(near, far, most)]

        return take

    rows = df.select(*frame, "is_track", "id", *BOX).withColumn("_one", F.lit(0))
    return ordered.folded(rows, frame, "_one", ["is_track", "id", *BOX], ["id"], None, begin, "track_id long, box_id long, cost double").drop(ordered.STRETCH)


def greedy_ground_truth(df: DataFrame, frame: list[str], least: float = 0.5) -> DataFrame:
    """Each true box of a frame (``is_truth``), in order of id, with the free prediction that overlaps it most."""

    def crowded(truth: list[tuple], guess: list[tuple]) -> list[tuple]:
        # Equal boxes are compared once; each has its free numbers, the first one last.
        same: dict[tuple, list] = {}
        for r in reversed(guess):
            same.setdefault(r[2:], []).append(r[1])
        boxes, free = np.array(list(same), float).reshape(-1, 4), list(same.values())
        left = np.arange(len(free))
        out = []
        for t in truth:
            shared = overlaps(np.array([t[2:]], float), boxes[left])[0]
            best = shared.max(initial=-1.0)
            if best < least:
                out.append((t[1], None, 0.0))
                continue
            j = min(left[shared == best], key=lambda k: free[k][-1])
            out.append((t[1], free[j].pop(), float(best)))
            if not free[j]:
                left = left[left != j]
        return out

    class Frames:
        """For ``ordered.together``: the frames of a block, each a lane of one step."""

        def __init__(self) -> None:
            self.n = 0

        def open(self, stretches: np.ndarray) -> None:
            self.n += len(stretches)

        def keep(self, lane: int) -> None:
            self.n = 1

        def end(self, lanes: np.ndarray) -> list:
            return []

        def step(self, lanes: np.ndarray, at: np.ndarray, lane: np.ndarray, rows: list[pa.Array]) -> Iterator[list]:
            side = np.array(rows[0].fill_null(False).to_numpy(zero_copy_only=False), bool) & rows[0].is_valid().to_numpy(zero_copy_only=False)
            other = ~side & rows[0].is_valid().to_numpy(zero_copy_only=False)
            pairs = np.bincount(lane[side], minlength=self.n) * np.bincount(lane[other], minlength=self.n)
            full = pairs > HELD
            for k in np.flatnonzero(full).tolist():
                truth, guess = ([r for r in zip(*(c.take(pa.array(np.flatnonzero(s & (lane == k)))).to_pylist() for c in rows), strict=True)] for s in (side, other))
                ids, found, shared = zip(*crowded(truth, guess), strict=True)
                yield [np.full(len(ids), k), pa.array(ids, pa.int64()), pa.array(found, pa.int64()), np.array(shared)]
            t, g = np.flatnonzero(side & ~full[lane]), np.flatnonzero(other & ~full[lane])
            boxes = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in rows[2:]])
            match, best = np.full(len(t), -1), np.zeros(len(t))
            taken = bytearray(len(g))
            for i, j in crossed(lane[t], lane[g]):
                shared = shared_by(boxes[t[i]], boxes[g[j]])
                near = np.flatnonzero(shared >= least)
                near = near[np.lexsort((j[near], -shared[near], i[near]))]
                done = -1
                for p, q, part in zip(i[near].tolist(), j[near].tolist(), shared[near].tolist(), strict=True):
                    if p != done and not taken[q]:
                        done, taken[q], match[p], best[p] = p, 1, q, part
            if len(t):
                guesses = rows[1].take(pa.array(g))
                yield [lane[t], rows[1].take(pa.array(t)).cast(pa.int64()), guesses.take(pa.array(match, mask=match < 0)).cast(pa.int64()), best]

    rows = df.select(*frame, "is_truth", "id", *BOX).withColumn("_one", F.lit(0))
    return ordered.together(rows, frame, "_one", ["is_truth", "id", *BOX], ["id"], None, Frames, "truth_id long, prediction_id long, iou double").drop(ordered.STRETCH)


def evaluated(truth: DataFrame, guess: DataFrame, camera: list[str], frame: str, least: float = 0.5) -> DataFrame:
    """One row: true and false positives, misses, ``precision``, ``recall``, and how often a true track's prediction changes.

    Both have the columns of ``greedy_ground_truth``; ``id`` numbers tracks. A change counts against the track's last
    matched frame. Without rows both rates are 0.
    """
    found = greedy_ground_truth(truth.unionByName(guess), [*camera, frame], least).where("prediction_id IS NOT NULL")
    before = F.lag("prediction_id").over(Window.partitionBy(*camera, "truth_id").orderBy(frame))
    hits = found.withColumn("_changed", before != F.col("prediction_id")).agg(F.count("*").alias("tp"), F.count_if("_changed").alias("id_switches"))
    counts = truth.agg(F.count("*").alias("t")).crossJoin(guess.agg(F.count("*").alias("g"))).crossJoin(hits)  # one row each
    rate = lambda of: F.round(F.col("tp") / F.greatest(F.lit(1), of), 4)
    return counts.select("tp", (F.col("g") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), rate("g").alias("precision"), rate("t").alias("recall"), "id_switches")
