"""Number plates: the consensus of several readings, plates inside vehicles, and when to read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchline.functions import text
from watchline.operators.joins import dealt

#: What a single reading needs, what readings that agree need, how many must agree, readings kept.
ACCEPT, AGREED, HITS, KEPT = 0.55, 0.45, 2, 12
#: Fixed value: sharpness beyond which a reading gains no more.
SHARP = 300.0


def verdict(confidence: Column, hits: Column) -> Column:
    """ACCEPTED by one sure reading or two, CONSENSUS by two weaker ones, else UNCERTAIN."""
    accepted = (confidence >= ACCEPT) & ((hits >= HITS) | (confidence >= ACCEPT + 0.15))
    return F.when(accepted, "ACCEPTED").when((confidence >= AGREED) & (hits >= HITS), "CONSENSUS").otherwise("UNCERTAIN")


def _leader(readings: Column) -> Column:
    """Readings of a track in order, each with the text of the first group whose first text it is like."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("names"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(state: Column, reading: Column) -> Column:
        like = F.filter(state["names"], lambda g: text.confusable(g, reading["text"]))
        found = F.coalesce(F.get(like, F.lit(0)), reading["text"])
        return F.struct(F.array_union(state["names"], F.array(found)).alias("names"), F.array_append(state["out"], found).alias("out"))

    return F.aggregate(readings, start, step, lambda s: s["out"])


def consensus(readings: DataFrame, track: str, order: list[str], plate: str = "text", confidence: str = "confidence", sharpness: str | None = None) -> DataFrame:
    """One plate for each track from its last 12 readings: the best group of readings alike, and its verdict.

    A group's score is its best confidence and a tenth for each reading, then its mean; the first group wins a tie.
    Its plate is that of the reading with the most confidence and, if ``sharpness`` is named, up to 0.2 for that.
    """
    back = Window.partitionBy(track).orderBy(*(F.desc(c) for c in order))
    last = readings.where(F.col(plate).isNotNull()).withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= KEPT)
    quality = F.col(confidence) + (0.2 * F.least(F.col(sharpness) / SHARP, F.lit(1.0)) if sharpness else F.lit(0.0))
    item = F.struct((-F.col("_n")).alias("at"), F.col(plate).alias("text"), F.col(confidence).alias("confidence"), quality.alias("quality"))
    listed = last.groupBy(track).agg(F.array_sort(F.collect_list(item)).alias("l"))
    rows = listed.select(track, F.explode(F.arrays_zip("l", _leader(F.col("l")).alias("g"))).alias("r")).select(track, "r.l.*", F.col("r.g").alias("g"))
    groups = rows.groupBy(track, "g").agg(
        F.max("confidence").alias("best"), F.count("*").alias("hits"), F.round(F.avg("confidence"), 9).alias("mean"),
        F.min("at").alias("first"), F.max_by("text", F.struct("quality", -F.col("at"))).alias("plate"),
    )
    score = F.struct(F.round(F.col("best") + 0.1 * F.least("hits", F.lit(KEPT)), 9), F.col("mean"), -F.col("first"))
    top = groups.groupBy(track).agg(F.max_by(F.struct("plate", "best", "hits"), score).alias("t"))
    return top.select(track, "t.plate", F.round("t.best", 4).alias("confidence"), "t.hits", verdict(F.col("t.best"), F.col("t.hits")).alias("verdict"))


def in_vehicles(vehicles: DataFrame, plates: DataFrame, frame: list[str], pad: float = 0.10) -> DataFrame:
    """Each vehicle with its surest plate: one that lies within the vehicle's box, a tenth larger on each side.

    ``v_`` and ``p_`` begin the names of the boxes' corners. Vehicles padded to under 24 pixels have none.
    """
    w, h = (F.col("v_x2") - F.col("v_x1")) * pad, (F.col("v_y2") - F.col("v_y1")) * pad
    within = [F.col("p_x1") >= F.col("v_x1") - w, F.col("p_y1") >= F.col("v_y1") - h, F.col("p_x2") <= F.col("v_x2") + w, F.col("p_y2") <= F.col("v_y2") + h]
    large = (F.col("v_x2") - F.col("v_x1") + 2 * w >= 24) & (F.col("v_y2") - F.col("v_y1") + 2 * h >= 24)
    mine, theirs = ([f"{p}_{c}" for c in ("x1", "y1", "x2", "y2")] for p in ("v", "p"))
    # Equal boxes of a frame meet once, and a pair keeps no more than the plate's rank, so that pairs are folded where they arise.
    ranked = plates.withColumn("_rank", F.row_number().over(Window.partitionBy(*frame).orderBy("confidence", F.desc("plate_id"))))
    best = ranked.groupBy(*frame, *theirs).agg(F.max("_rank").alias("_rank"))
    pairs = dealt(vehicles.where(large).select(*frame, *mine).distinct(), frame).join(dealt(best, frame).hint("merge"), frame).where(reduce(lambda a, b: a & b, within))
    found = pairs.groupBy(*frame, *mine).agg(F.max("_rank").alias("_rank")).join(ranked.select(*frame, "_rank", "plate_id", "confidence"), [*frame, "_rank"])
    return vehicles.join(found, [*frame, *mine]).groupBy("vehicle_id").agg(F.max_by("plate_id", F.struct("confidence", -F.col("plate_id"))).alias("plate_id"))
