"""Structured Streaming twins of the stateful operators.

The reference order is arrival order; here rows carry their own time, and rows later than the watermark are
dropped. Within a micro-batch a key's rows are taken in order of time and sequence. Every key has a timer in event
time: once the watermark has passed the time from which its state changes nothing, the state goes, so that no more
keys are kept than are seen within the watermark and that time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from watchline.functions import geo
from watchline.operators.events import sequenced
from watchline.operators.folds import seconds
from watchline.operators.zones import paired

#: How late a row may be.
WATERMARK = "10 minutes"
#: Seconds after which a track that isn't seen counts as gone.
DORMANT = 86_400.0


def timed(stream: DataFrame, ts: str) -> DataFrame:
    """``stream`` with its event time as ``_time``, watermarked."""
    return stream.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", WATERMARK)


def forgotten_at(state: GroupState, at: float) -> None:
    """Sets the key's timer to ``at`` seconds, or to the next moment if the watermark has passed that already."""
    state.setTimeoutTimestamp(max(int(at * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def folded(rows: DataFrame, keys: list[str], step: Callable, schema: str, state: str) -> DataFrame:
    """applyInPandasWithState with a timer in event time, on rows that ``timed`` has given."""
    return rows.groupBy(*keys).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def in_order(batches: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    return sorted(row for pdf in batches for row in zip(*(pdf[c] for c in columns), strict=True))


def debounced(stream: DataFrame, keys: list[str], ts: str, seq: str, cooldown: float) -> DataFrame:
    """Rows (``seq``) that come at least ``cooldown`` seconds after the key's last emitted row.

    A key is forgotten when the watermark has passed its cooldown: the next row would be emitted in any case.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t, s in in_order(batches, "t", "s"):
            if last is None or t - last >= cooldown:
                last = t
                out.append(s)
        if last is not None:
            state.update((last,))
            forgotten_at(state, last + cooldown)
        yield pd.DataFrame({seq: pd.Series(out, dtype="int64")})

    rows = timed(stream, ts).select(*keys, "_time", seconds(F.col(ts)).alias("t"), F.col(seq).cast("long").alias("s"))
    return folded(rows, keys, step, f"`{seq}` long", "last double")


def zone_transitions(stream: DataFrame, track: list[str], ts: str, seq: str, zones: DataFrame, dormant: float = DORMANT) -> DataFrame:
    """Rows at which a track enters or leaves a zone of a small static table, with the dwell on leaving.

    A track that was last seen inside and then not for ``dormant`` seconds leaves by its timer: ``seq`` is null, ``at``
    that moment, and the dwell 0. Only tracks inside a zone have a state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, entry, last = state.get if state.exists else (False, 0.0, 0.0)
        out = []

        def gone() -> None:
            out.append((None, key[-1], "exited", 0.0, last + dormant))

        if state.hasTimedOut:
            gone()
            inside = False
        for t, s, now in [] if state.hasTimedOut else in_order(batches, "t", "s", "inside"):
            if inside and t - last > dormant:
                gone()
                inside = False
            if now and not inside:
                entry = t
                out.append((s, key[-1], "entered", 0.0, t))
            elif inside and not now:
                out.append((s, key[-1], "exited", t - entry, t))
            inside, last = bool(now), t
        if inside:
            state.update((True, float(entry), float(last)))
            forgotten_at(state, last + dormant)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[seq, "zone_id", "transition", "dwell_seconds", "at"]).astype({seq: "Int64", "dwell_seconds": "float64", "at": "float64"})

    inside = geo.zone_contains(F.col("x"), F.col("y"), F.col("polygon"))
    rows = paired(timed(stream, ts), zones).select(*track, "zone_id", "_time", seconds(F.col(ts)).alias("t"), F.col(seq).cast("long").alias("s"), inside.alias("inside"))
    return folded(rows, [*track, "zone_id"], step, f"`{seq}` long, zone_id string, transition string, dwell_seconds double, at double", "inside boolean, entry double, last double")


def tripwire_crossings(stream: DataFrame, track: list[str], ts: str, seq: str, wire: tuple[float, float, float, float], cooldown: float = 3.0, dormant: float = DORMANT) -> DataFrame:
    """Rows whose move from the track's last position crosses a wire, at most one each ``cooldown`` seconds.

    A position older than ``dormant`` seconds is forgotten.
    """
    ax, ay, bx, by = wire

    def side(px: float, py: float, qx: float, qy: float, rx: float, ry: float) -> float:
        return (ry - py) * (qx - px) - (qy - py) * (rx - px)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        px, py, last, seen = state.get if state.exists else (None, None, None, None)
        out = []
        for t, s, x, y in in_order(batches, "t", "s", "x", "y"):
            if seen is not None and t - seen <= dormant:
                d1, d2 = side(ax, ay, bx, by, px, py), side(ax, ay, bx, by, x, y)
                d3, d4 = side(px, py, x, y, ax, ay), side(px, py, x, y, bx, by)
                if d1 * d2 < 0 and d3 * d4 < 0 and (x - px) ** 2 + (y - py) ** 2 >= 2.5**2 and (last is None or t - last >= cooldown):
                    last = t
                    out.append((s, "inbound" if d1 > 0 else "outbound"))
            px, py, seen = x, y, t
        if seen is not None:
            state.update((px, py, last, seen))
            forgotten_at(state, max(seen + dormant, (last or 0.0) + cooldown))
        yield pd.DataFrame(out, columns=[seq, "crossing"]).astype({seq: "int64"})

    rows = timed(stream, ts).select(*track, "_time", seconds(F.col(ts)).alias("t"), F.col(seq).cast("long").alias("s"), "x", "y")
    return folded(rows, track, step, f"`{seq}` long, crossing string", "x double, y double, last double, seen double")


def incident_sessions(stream: DataFrame, keys: list[str], ts: str, score: str, gap: str = "120 seconds") -> DataFrame:
    """Incidents as session windows by key, closed once the watermark has passed them."""
    return (
        stream.withWatermark(ts, WATERMARK)
        .groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n_events"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.max(score).alias("peak_threat"))
        .drop("w")
    )


def latest_before(entries: np.ndarray, exits: np.ndarray, most: int, least: int = 500_000) -> np.ndarray:
    """The place of each entry's latest exit from another camera, ``least`` to ``most`` before it, -1 for none.

    Both have rows of time, number and camera; exits are in order of time and number.
    """
    if not len(exits):
        return np.full(len(entries), -1)
    camera = exits[:, 2]
    starts = np.r_[True, camera[1:] != camera[:-1]]
    before_run = np.maximum.accumulate(np.where(starts, np.arange(len(exits)), 0)) - 1
    at = np.searchsorted(exits[:, 0], entries[:, 0] - least, "right") - 1
    at = np.where((at >= 0) & (camera[at] == entries[:, 2]), before_run[at], at)
    return np.where((at >= 0) & (exits[at, 0] >= entries[:, 0] - most), at, -1)


def correlated(exits: DataFrame, entries: DataFrame, most: int = 60) -> DataFrame:
    """Pairs of an entry and the latest exit of its class from another camera so far, within ``most`` seconds.

    Times are cut into buckets of ``most`` seconds, and an exit counts for its own and the next, which has a state of its own. An
    entry comes again only where a later exit turns up for it, so that pairs grow with the rows and not with their square.
    """
    span = most * 1_000_000
    side = lambda rows, is_exit: rows.where("object_class IS NOT NULL AND camera_id IS NOT NULL AND ts IS NOT NULL").select(
        "object_class", F.col("ts").alias("_time"), F.unix_micros("ts").alias("t"), F.col("event_id").alias("i"), F.col("camera_id").alias("c"), F.lit(is_exit).alias("is_exit")
    )
    bucket = F.floor(F.col("t") / span)
    rows = side(exits, True).unionByName(side(entries, False)).withWatermark("_time", WATERMARK)
    rows = rows.withColumn("bucket", F.explode(F.when(F.col("is_exit"), F.array(bucket, bucket + 1)).otherwise(F.array(bucket))))
    names = ["entry_id", "to_camera", "entry_t", "exit_id", "from_camera", "exit_t"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        none = np.empty((0, 3), np.int64)
        old_exits, old_entries = (np.frombuffer(b, np.int64).reshape(-1, 3) for b in state.get) if state.exists else (none, none)
        new = pd.concat(list(batches))
        part = lambda which: new.loc[which, ["t", "i", "c"]].to_numpy(np.int64)
        is_exit = new["is_exit"].to_numpy(bool)
        known = np.concatenate([old_exits, part(is_exit)])
        known = known[np.lexsort((known[:, 1], known[:, 0]))]
        waiting = np.concatenate([old_entries, part(~is_exit)])
        found = latest_before(waiting, known, span)
        was = np.r_[latest_before(old_entries, old_exits, span), np.full(len(waiting) - len(old_entries), -1)]
        now, before = (np.concatenate([rows, np.full((1, 3), -(2**63))])[at] for rows, at in ((known, found), (old_exits, was)))
        fresh = np.flatnonzero((found >= 0) & (now != before).any(axis=1))
        state.update((known.tobytes(), waiting.tobytes()))
        forgotten_at(state, (key[1] + 1) * most)
        a, b = waiting[fresh], now[fresh]
        yield pd.DataFrame(np.column_stack([a[:, 1], a[:, 2], a[:, 0], b[:, 1], b[:, 2], b[:, 0]]), columns=names)

    pairs = folded(rows, ["object_class", "bucket"], step, ", ".join(f"{n} long" for n in names), "exits binary, entries binary")
    return pairs.withColumns({"entry_ts": F.timestamp_micros("entry_t"), "exit_ts": F.timestamp_micros("exit_t")}).drop("entry_t", "exit_t")


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table in ``folder``, where its progress is kept too."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def latest_exits(pairs: DataFrame) -> DataFrame:
    """Of ``correlated`` pairs each entry's latest exit, with the seconds between."""
    best = pairs.groupBy("entry_id").agg(F.max_by(F.struct(*(c for c in pairs.columns if c != "entry_id")), F.struct("exit_ts", "exit_id")).alias("b"))
    return best.select("entry_id", "b.*").withColumn("delta_seconds", seconds(F.col("entry_ts")) - seconds(F.col("exit_ts")))


def stored_before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """Rows that earlier batches than ``number`` have stored; None where nothing is stored yet."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return stored.where(F.col("batch") < number)


def retried(run: Callable[[], Any], retries: int = 5, pause: Callable[[float], None] = time.sleep) -> Any:
    """``run()``, tried up to ``retries`` times with rising pauses of 2^k * 10 + 5k milliseconds; the last error is raised."""
    for attempt in range(retries):
        try:
            return run()
        except Exception:
            if attempt == retries - 1:
                raise
            pause((2**attempt * 10 + attempt * 5) / 1000)
    raise ValueError("retries has to be 1 or more")


def persisted_then_published(
    path: str, publish: Callable[[DataFrame, int], Any], key: str = "event_id", order: list[str] | None = None, day: Column | None = None, retries: int = 5
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows of new keys are stored with ``seq_id``, by batch, and only then published.

    ``seq_id`` goes on from batch to batch without a gap, in ``order`` (by default of the key) within a batch. Keys that
    an earlier batch has stored are left out; where ``day`` is given, a key's rows have one day, rows are stored by it
    and only the batch's days are looked up. A batch that is run again, by a retry here or a restart, overwrites its own
    folder with the same numbers, so that nothing is added twice and no number is left out.
    """

    def stored(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]) if day is None else batch.withColumn("day", day).dropDuplicates([key])
        known, used = stored_before(spark, path, number), 0
        if known is not None:
            used = known.count()
            keys = [key] if day is None else [key, "day"]
            if day is not None:
                days = [r[0] for r in fresh.select("day").distinct().limit(1001).collect()]
                known = known if len(days) > 1000 else known.where(F.col("day").isin(days))
            fresh = fresh.join(known.select(*keys), keys, "left_anti")
        written = sequenced(fresh, order or [key], used).write.mode("overwrite")
        (written if day is None else written.partitionBy("day")).parquet(f"{path}/batch={number}")
        return spark.read.parquet(f"{path}/batch={number}")

    def run(batch: DataFrame, number: int) -> None:
        rows = retried(lambda: stored(batch, number), retries)
        publish(rows, number)

    return run
