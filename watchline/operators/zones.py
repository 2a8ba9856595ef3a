"""Zone and tripwire operators over tracked positions: enter, exit, dwell, loiter, cross."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchline.functions import geo
from watchline.operators.folds import emit_with_cooldown, seconds


#: Zones or wires that a site has at most; more need a camera to be joined on.
MOST_AREAS = 1000


def paired(positions: DataFrame, areas: DataFrame) -> DataFrame:
    """Each position with each active area of its camera, or with each at all where areas have no ``camera_id``.

    Areas of cameras are joined by the camera; those of none are broadcast, and refused beyond ``MOST_AREAS``.
    """
    active = areas.where("is_active")
    if "camera_id" in areas.columns:
        return positions.join(active, "camera_id")
    if active.limit(MOST_AREAS + 1).count() > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} areas without a camera")
    return positions.join(F.broadcast(active), how="cross")


def positions_in_zones(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """Each position with each active zone of ``paired``, and whether it lies ``inside``."""
    return paired(positions, zones).withColumn("inside", geo.zone_contains(F.col("x"), F.col("y"), F.col("polygon")))


def transitions(inside: DataFrame, track: list[str], ts: str, seq: str, initial_inside_enters: bool = True, dormant: float | None = None) -> DataFrame:
    """Rows at which a track enters or leaves a zone, and on leaving its dwell in seconds.

    A track that isn't seen for more than ``dormant`` seconds has left meanwhile; see ``dormant_exits``.
    """
    w = Window.partitionBy(*track, "zone_id").orderBy(ts, seq)
    before = F.lag("inside").over(w)
    if dormant is not None:
        before = F.when(seconds(F.col(ts)) - seconds(F.lag(ts).over(w)) > dormant, False).otherwise(before)
    entered = F.col("inside") & ~F.coalesce(before, F.lit(not initial_inside_enters))
    rows = inside.withColumn("before", before).withColumn("entered", entered)
    rows = rows.withColumn("entry", F.last(F.when(F.col("entered"), seconds(F.col(ts))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = ~F.col("inside") & F.coalesce(F.col("before"), F.lit(False)) & F.col("entry").isNotNull()
    kind = F.when(F.col("entered"), "entered").when(left, "exited")
    dwell = F.when(left, seconds(F.col(ts)) - F.col("entry")).otherwise(0.0)
    return rows.withColumn("transition", kind).where("transition IS NOT NULL").withColumn("dwell_seconds", dwell).drop("before", "entered", "entry", "inside")


def dormant_exits(inside: DataFrame, track: list[str], ts: str, seq: str, dormant: float) -> DataFrame:
    """Exits of tracks that were last seen inside and then not for ``dormant`` seconds: the last row's ``seq``, and ``at`` in seconds."""
    w = Window.partitionBy(*track, "zone_id").orderBy(ts, seq)
    at, after = seconds(F.col(ts)), F.lead(seconds(F.col(ts))).over(w)
    rows = inside.withColumns({"at": at + dormant, "_gone": after.isNull() | (after - at > dormant)})
    return rows.where("inside AND _gone").select(*track, "zone_id", seq, "at")


def visits(inside: DataFrame, track: list[str], ts: str, seq: str) -> DataFrame:
    """Rows inside a zone with the number of their visit and the time since it began (``dwell_seconds``)."""
    w = Window.partitionBy(*track, "zone_id").orderBy(ts, seq)
    entered = F.when(F.col("inside") & ~F.coalesce(F.lag("inside").over(w), F.lit(False)), 1).otherwise(0)
    rows = inside.withColumn("visit", entered).withColumn("visit", F.sum("visit").over(w)).where("inside")
    start = F.min(seconds(F.col(ts))).over(Window.partitionBy(*track, "zone_id", "visit"))
    return rows.withColumn("dwell_seconds", seconds(F.col(ts)) - start)


def loitering(inside: DataFrame, track: list[str], ts: str, seq: str, threshold: float, debounce: float) -> DataFrame:
    """Rows at which a visit has lasted ``threshold`` seconds, again every ``debounce`` seconds at the earliest."""
    long = visits(inside, track, ts, seq).where(F.col("dwell_seconds") >= threshold)
    return emit_with_cooldown(long, [*track, "zone_id", "visit"], ts, seq, debounce)


def tripwire_crossings(positions: DataFrame, wires: DataFrame, track: list[str], ts: str, seq: str) -> DataFrame:
    """Moves of a track that cross a wire of ``paired``, with the ``crossing`` direction."""
    w = Window.partitionBy(*track).orderBy(ts, seq)
    moves = positions.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).where("px IS NOT NULL")
    wire = (F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    pairs = paired(moves, wires)
    found = geo.crossing(F.col("px"), F.col("py"), F.col("x"), F.col("y"), wire, F.col("direction"))
    return pairs.withColumn("crossing", found).where("crossing IS NOT NULL")


def occupancy(inside: DataFrame, track: list[str], ts: str, seq: str) -> DataFrame:
    """Tracks that are inside a zone at their last position, by zone."""
    last = inside.groupBy(*track, "zone_id").agg(F.max_by("inside", F.struct(ts, seq)).alias("inside"))
    return last.groupBy("zone_id").agg(F.count_if("inside").alias("occupied"))


def operator_alerts(alerts: DataFrame, track: list[str], ts: str, seq: str, rank: str, cooldown: float = 8.0) -> DataFrame:
    """The severest alert of each track and time, then at most one each ``cooldown`` seconds; a rise comes through."""
    top = alerts.withColumn("_n", F.row_number().over(Window.partitionBy(*track, ts).orderBy(F.desc(rank), seq))).where("_n = 1").drop("_n")
    rises = F.coalesce(F.col(rank) > F.lag(rank).over(Window.partitionBy(*track).orderBy(ts, seq)), F.lit(False))
    return emit_with_cooldown(top.withColumn("_rises", rises), track, ts, seq, cooldown, bypass=F.col("_rises")).drop("_rises")
