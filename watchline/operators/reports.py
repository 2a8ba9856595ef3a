"""Analytical outputs: heatmaps, dossiers, sector threat, journeys, churn, percentiles, hash chains."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from watchline.functions import scoring
from watchline.operators import ordered
from watchline.operators.events import truthy
from watchline.operators.folds import seconds


def heatmap(rows: DataFrame, x: str, y: str, width: float, height: float, grid: int = 16, hot: float = 0.6) -> DataFrame:
    """Counts over a dense grid, their share of the fullest cell, and which cells are hotspots."""
    cell = lambda c, size: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(F.col(c) / size * grid)))
    counts = rows.groupBy(cell(x, width).cast("long").alias("cx"), cell(y, height).cast("long").alias("cy")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    cells = spark.range(grid * grid).select(F.expr(f"id div {grid}").alias("cx"), (F.col("id") % grid).alias("cy"))
    # The grid has grid * grid rows, so that one window over it is small.
    full = cells.join(counts, ["cx", "cy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.nullif(F.max("n").over(Window.partitionBy(F.lit(1))), F.lit(0))
    share = F.coalesce(share, F.lit(0.0))
    return full.select("cx", "cy", "n", F.round(share, 3).alias("heat"), (share >= hot).alias("hotspot"))


def dossiers(rows: DataFrame, key: str, ts: str, seq: str, speed: str) -> DataFrame:
    """Events, duration, mean speed and displacement from the first to the last position, by entity."""
    order, at = F.struct(ts, seq), F.struct("x", "y")
    g = rows.groupBy(key).agg(
        F.count("*").alias("n_events"), F.round(F.max(seconds(F.col(ts))) - F.min(seconds(F.col(ts))), 3).alias("duration"),
        F.round(F.avg(speed), 6).alias("mean_speed"), F.min_by(at, order).alias("a"), F.max_by(at, order).alias("b"),
    )
    return g.withColumn("displacement", F.round(F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")), 1)).drop("a", "b")


def sector_threat(rows: DataFrame, sector: str, kinds: dict[str, Column], track: str) -> DataFrame:
    """Counts of tripwire, restricted and loitering events, distinct tracks, and the index, by sector."""
    g = rows.groupBy(sector).agg(*(F.count_if(c).alias(name) for name, c in kinds.items()), F.countDistinct(track).alias("tracks"))
    return g.withColumn("score", scoring.sector_index(F.col("tripwires"), F.col("restricted"), F.col("loitering"), F.col("tracks")))


def index_percentiles(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Percentiles by place in order (not interpolated): the n//2-th and the int(0.95 n)-th value, from 0."""
    n = F.count("*").over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie)) - 1
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, value, n.alias("n"), at.alias("at"))
    pick = lambda place: F.max(F.when(F.col("at") == place, F.col(value)))
    return ranked.groupBy(*keys).agg(pick(F.floor(F.col("n") / 2)).alias("p50"), pick(F.floor(F.col("n") * 0.95)).alias("p95"))


def display_ids(rows: DataFrame, ts: str, tie: str, prefix: str) -> DataFrame:
    """Rows numbered by time over all, without one task for all: within each day, after the days before."""
    daily = rows.withColumn("_day", F.to_date(ts))
    own = F.row_number().over(Window.partitionBy("_day").orderBy(ts, tie))
    sizes = daily.groupBy("_day").agg(F.count("*").alias("_n"))
    # Days are few beside the rows; only their counts are summed up in one order.
    before = sizes.select("_day", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    text = (F.col("_own") + F.col("_before")).cast("string")
    numbered = daily.withColumn("_own", own).join(F.broadcast(before), "_day")
    return numbered.withColumn("display_id", F.concat(F.lit(prefix), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))).drop("_day", "_own", "_before")


def lifespans(rows: DataFrame, track: str, frame: str, confidence: str) -> DataFrame:
    """Sightings, first and last frame, longest gap and mean confidence of each track."""
    gap = F.col(frame) - F.lag(frame).over(Window.partitionBy(track).orderBy(frame))
    return rows.withColumn("_gap", gap).groupBy(track).agg(
        F.count("*").alias("sightings"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("max_gap"), F.round(F.avg(confidence), 6).alias("mean_confidence"),
    )


def churn(rows: DataFrame, frame: str, track: str, span: Column | None = None) -> DataFrame:
    """Ids of each frame that are new against the frame before, and those that stayed.

    The frame before is sought within each ``span`` (rising with the frames; by default a thousand numbers); only
    the spans' last frames are put in one order.
    """
    seen = rows.select(frame, track).distinct()
    frames = seen.select(frame).distinct().withColumn("_span", F.floor(F.col(frame) / 1000) if span is None else span)
    ends = frames.groupBy("_span").agg(F.max(frame).alias("_end"))
    carried = ends.select("_span", F.lag("_end").over(Window.orderBy("_span")).alias("_carried"))
    within = frames.withColumn("_own", F.lag(frame).over(Window.partitionBy("_span").orderBy(frame)))
    previous = within.join(carried, "_span").select(frame, F.coalesce("_own", "_carried").alias("_prev"))
    before = seen.select(F.col(frame).alias("_prev"), track, F.lit(True).alias("_was"))
    rows = seen.join(previous, frame).join(before, ["_prev", track], "left")
    return rows.groupBy(frame).agg(F.count_if(F.col("_was").isNull()).alias("n_new"), F.count_if(F.col("_was").isNotNull()).alias("n_kept"))


def event_hash(*fields: Column) -> Column:
    """SHA-256 of fields joined by a bar; a null field is empty, not left out."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def chain_root(rows: DataFrame, keys: list[str], hashed: str, order: list[str]) -> DataFrame:
    """SHA-256 of each group's hashes one after the other, the newest first; a group is streamed, not gathered.

    ``order`` are times or numbers; null ones count as the newest.
    """
    back = {f"_back{i}": F.coalesce(-(F.unix_micros(F.col(c).cast("timestamp")) if not isinstance(rows.schema[c].dataType, NumericType) else F.col(c).cast("long")), F.lit(-(2**63))) for i, c in enumerate(order)}

    def begin(stretch: int):
        root, n = hashlib.sha256(), 0

        def take(at: int | None, some: list[tuple] | None) -> list[tuple]:
            nonlocal n
            if some is None:
                return [(root.hexdigest(), n)]
            for (h,) in some:
                root.update((h or "").encode())
                n += 1
            return []

        return take

    steps = list(back)
    found = ordered.folded(rows.select(*keys, *order, hashed).withColumns(back), keys, steps[0], [hashed], steps[1:], None, begin, "root string, n long")
    return found.drop(ordered.STRETCH)


def journeys(rows: DataFrame, entity: str, camera: str, ts: str, seq: str) -> DataFrame:
    """An entity's stays at cameras in order: hop number, camera, arrival, and departure (the next arrival)."""
    w = Window.partitionBy(entity).orderBy(ts, seq)
    moved = rows.withColumn("_from", F.lag(camera).over(w)).withColumn("_last", F.max(ts).over(Window.partitionBy(entity)))
    moved = moved.where(F.col("_from").isNull() | (F.col("_from") != F.col(camera)))
    return moved.select(
        entity, F.row_number().over(w).cast("long").alias("hop"), F.col("_from").alias("from_camera"), F.col(camera).alias("camera"),
        F.col(ts).alias("arrived"), F.coalesce(F.lead(ts).over(w), F.col("_last")).alias("left"),
    )


def followed(entities: DataFrame, transitions: DataFrame, tracks: DataFrame) -> DataFrame:
    """The hops of every entity, by what is known of it: ``hop, camera, track, entered, last_seen, duration, confidence, from_camera``.

    With transitions and at most one local track, the chain of transitions after the first one's origin; without tracks,
    the entity's current camera as one hop; else its local tracks by their first sighting, each after the first with the
    earliest transition to it. Entities (entity, first_seen, last_seen, camera, track) have a row each; transitions
    (entity, from_camera, from_track, to_camera, to_track, confidence, at, seq) and tracks (entity, camera, track,
    first_seen, last_seen) any number. An entity of which nothing is known has no hop.
    """
    known = entities.join(transitions.groupBy("entity").agg(F.count("*").alias("n_moves")), "entity", "left").join(tracks.groupBy("entity").agg(F.count("*").alias("n_tracks")), "entity", "left")
    known = known.fillna(0, ["n_moves", "n_tracks"])
    chain = (F.col("n_moves") > 0) & (F.col("n_tracks") <= 1)
    single = ~chain & (F.col("n_tracks") == 0) & F.col("camera").isNotNull()
    w = Window.partitionBy("entity").orderBy("at", "seq")
    whole = known.where(chain).select("entity", F.col("first_seen").alias("begun"), F.col("last_seen").alias("ended"))
    moves = transitions.join(whole, "entity").withColumns({"n": F.row_number().over(w), "next": F.coalesce(F.lead("at").over(w), F.col("ended"))})
    hops = lambda rows, hop, camera, track, entered, last, confidence, before: rows.select("entity", hop.cast("long").alias("hop"), F.col(camera).alias("camera"), F.col(track).alias("track"), F.col(entered).alias("entered"), F.col(last).alias("last_seen"), confidence.alias("confidence"), before.alias("from_camera"))
    none, sure, one = F.lit(None).cast(transitions.schema["from_camera"].dataType), F.lit(1.0), F.lit(1)
    first = hops(moves.where("n = 1"), one, "from_camera", "from_track", "begun", "at", sure, none)
    rest = hops(moves, F.col("n") + 1, "to_camera", "to_track", "at", "next", F.col("confidence"), F.col("from_camera"))
    alone = known.where(single).withColumn("track", F.coalesce("track", F.lit("LOCAL-1")))
    alone = hops(alone, one, "camera", "track", "first_seen", "last_seen", sure, none)
    own = tracks.join(known.where(~chain & (F.col("n_tracks") > 0)).select("entity"), "entity")
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("first_seen", "camera", "track")))
    arrival = transitions.groupBy("entity", F.col("to_camera").alias("camera"), F.col("to_track").alias("track")).agg(F.min_by(F.struct("from_camera", "confidence"), F.struct("at", "seq")).alias("a"))
    met = own.join(arrival, ["entity", "camera", "track"], "left").withColumn("a", F.when(F.col("n") > 1, F.col("a")))
    by_tracks = hops(met, F.col("n"), "camera", "track", "first_seen", "last_seen", F.coalesce("a.confidence", sure), F.col("a.from_camera"))
    lasted = F.greatest(F.lit(0.0), seconds(F.col("last_seen")) - seconds(F.col("entered")))
    return first.unionByName(rest).unionByName(alone).unionByName(by_tracks).withColumn("duration", lasted)


def newest(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Each key's newest ``n`` rows by ``order``, with ``place`` 1 for the newest."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def sector_assessment(events: DataFrame, sector: str, track: str, ts: str, seq: str, now: Column, look_back: float, alerts: int = 50, others: int = 200) -> DataFrame:
    """Each sector's counts, signs, distinct tracks, score and level over the ``look_back`` seconds before ``now``.

    Of alerts the newest ``alerts`` are taken first, and then those in time; of all events the newest ``others`` in time.
    Events have ``event_type``, ``message``, ``narrative``, ``transition``, ``zone_name``, ``zone_severity`` and ``severity``. An
    alert is critical if its words cross, breach or name a tripwire, or its severity is; restricted and loitering go by
    words as well. Sectors without any event in time are left out.
    """
    since = now - F.make_dt_interval(secs=F.lit(look_back).cast("decimal(18,6)"))
    words = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("message", "narrative", "transition", "zone_name", "zone_severity"))))
    severity = F.upper(F.coalesce(truthy(F.col("severity")), truthy(F.col("zone_severity")), F.lit("")))
    has = lambda text, *some: reduce(lambda a, b: a | b, (text.contains(w) for w in some))
    a = newest(events.where("event_type = 'ALERT'"), [sector], [ts, seq], alerts).where(F.col(ts) >= since)
    a = a.select(
        sector, (has(words, "crossed", "breach", "tripwire") | severity.contains("CRITICAL")).alias("critical"), (has(words, "restricted") | severity.contains("RESTRICTED")).alias("restricted"),
        has(words, "loiter", "dwelling").alias("loitering"), has(words, "night").alias("night"), has(words, "protected", "checkpoint").alias("protected"),
    )
    counted = a.groupBy(sector).agg(*(F.count_if(c).alias(c) for c in ("critical", "restricted", "loitering")), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(f"{c}_alert") for c in ("night", "protected")))
    e = newest(events.where(F.col(ts) >= since), [sector], [ts, seq], others)
    zone = F.col("event_type") == "ZONE"
    seen = e.groupBy(sector).agg(
        F.countDistinct(track).alias("tracks"), F.bool_or(zone & has(words, "crossed")).alias("crossed"), F.bool_or(zone & has(words, "entered") & has(words, "restricted", "critical")).alias("intruded"),
        F.bool_or(zone & has(words, "protected")).alias("protected_zone"), F.bool_or(has(words, "night")).alias("night_event"),
    )
    rows = seen.join(counted, sector, "left").fillna(0, ["critical", "restricted", "loitering"]).fillna(False, ["night_alert", "protected_alert"])
    intrusion = F.col("crossed") | F.col("intruded") | (F.col("critical") > 0) | (F.col("restricted") > 0)
    flags = {"night": F.col("night_alert") | F.col("night_event"), "protected": F.col("protected_alert") | F.col("protected_zone"), "intrusion": intrusion}
    s = scoring.sector_score(F.col("critical"), F.col("restricted"), F.col("loitering"), F.col("tracks"), flags)
    return rows.withColumn("s", s).select(sector, "critical", "restricted", "loitering", "tracks", F.col("s.raw").alias("raw"), F.col("s.score").alias("score"), F.col("s.level").alias("level"))


def listed(rows: DataFrame, key: str, value: str, order: list[str], n: int | None, name: str) -> DataFrame:
    """Each key's newest ``n`` values (all: None) as an array ``name``, the newest first."""
    top = rows if n is None else newest(rows, [key], order, n)
    pairs = F.reverse(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v")))))
    return top.groupBy(key).agg(F.transform(pairs, lambda r: r["v"]).alias(name))


def person_profiles(entities: DataFrame, tracks: DataFrame, faces: DataFrame, incidents: DataFrame, transitions: DataFrame) -> DataFrame:
    """Profiles by ``entity``: ``local_tracks`` (camera to tracks), ``cameras``, the newest ten ``faces`` and ``incidents``,
    ``transitions``, and the ``peak_threat`` of those incidents with its ``threat_level``.

    Entities (entity, camera, track) have a row each, their current place counting as observed; tracks (entity, camera,
    track), faces (entity, face_id, at), incidents (entity, incident_id, at, peak) and transitions (entity) any number.
    """
    places = tracks.select("entity", "camera", "track").union(entities.where("camera IS NOT NULL").select("entity", "camera", "track")).distinct()
    by_camera = places.groupBy("entity", "camera").agg(F.array_sort(F.collect_list("track")).alias("t"))
    seen = by_camera.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("camera", "t")))).alias("local_tracks"), F.array_sort(F.collect_list("camera")).alias("cameras"))
    last = newest(incidents, ["entity"], ["at", "incident_id"], 10)
    peaks = last.groupBy("entity").agg(F.max("peak").alias("peak_threat"))
    moved = transitions.groupBy("entity").agg(F.count("*").alias("transitions"))
    rows = entities.select("entity").join(seen, "entity", "left").join(listed(faces, "entity", "face_id", ["at", "face_id"], 10, "faces"), "entity", "left")
    rows = rows.join(listed(last.drop("place"), "entity", "incident_id", ["at", "incident_id"], None, "incidents"), "entity", "left").join(peaks, "entity", "left").join(moved, "entity", "left")
    rows = rows.fillna(0, ["transitions"]).withColumn("peak_threat", F.greatest(F.lit(0.0), F.coalesce("peak_threat", F.lit(0.0))))
    return rows.withColumn("threat_level", scoring.band(F.col("peak_threat"), scoring.PROFILE_LEVELS, "NORMAL"))


def vehicle_plates(plates: DataFrame) -> DataFrame:
    """Each vehicle's ``plates`` (entity, plate, confidence, observation_id) by confidence, the best first, and its best plate."""
    by = F.array_sort(F.collect_list(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("less"), "observation_id", "plate")))
    rows = plates.groupBy("entity").agg(by.alias("p"))
    first = F.col("p")[0]
    return rows.select("entity", F.transform("p", lambda r: r["plate"]).alias("plates"), first["plate"].alias("best_plate"), (-first["less"]).alias("best_confidence"))


def influx(rows: DataFrame, keys: list[str], ts: str, count: str, seconds: float = 10.0, most: int = 15, least_points: int = 3, least_count: int = 3, threshold: float = 0.40) -> DataFrame:
    """Rows with the ``slope`` of their key's counts a second, and whether the rise is ``rapid``.

    The slope is a regression over the samples of the last ``seconds``, the newest ``most`` of them; fewer than
    ``least_points``, or samples at one time, give 0. A rapid rise is of ``threshold`` or more and ends at ``least_count``.
    """
    # A key's time is cut into pieces of sixty windows, so that no task holds a key's history. A row reaches no further back than one
    # window, as more than ``most`` samples within it hold the newest ``most``; rows that late in a piece are in the next one too.
    at, reach = (F.col(ts) * 1e6).cast("long"), int(seconds * 1e6)
    piece = F.floor(at / (60 * reach))
    pieces = F.when(at + reach >= (piece + 1) * (60 * reach), F.array(piece, piece + 1)).otherwise(F.array(piece))
    given = rows.columns
    rows = rows.withColumns({"_own": piece, "_piece": F.explode(pieces)}).withColumn("_own", F.col("_own").eqNullSafe(F.col("_piece")))
    w = Window.partitionBy(*keys, "_piece").orderBy(at).rangeBetween(-reach, 0)
    last = Window.partitionBy(*keys, "_piece").orderBy(ts).rowsBetween(1 - most, 0)
    y, t = F.col(count).cast("double"), F.col(ts)
    # Times are taken from the row's own, as squares of large numbers leave no digits for the differences.
    n = F.count("*").over(w)
    samples = F.when(n > most, F.collect_list(F.struct(t.alias("t"), y.alias("y"))).over(last)).otherwise(F.collect_list(F.struct(t.alias("t"), y.alias("y"))).over(w))
    size = F.size("_s")
    mean = lambda f: F.aggregate(F.col("_s"), F.lit(0.0), lambda a, s: a + f(s)) / size
    moved = rows.withColumn("_s", samples).where("_own").select(*given, "_s").withColumn("_s", F.transform("_s", lambda s: F.struct((s["t"] - F.col(ts)).alias("t"), s["y"].alias("y"))))
    mt, my = mean(lambda s: s["t"]), mean(lambda s: s["y"])
    cov, var = mean(lambda s: s["t"] * s["y"]) - mt * my, mean(lambda s: s["t"] * s["t"]) - mt * mt
    slope = F.when((size >= least_points) & (var >= 1e-6), cov / var).otherwise(0.0)
    return moved.withColumn("_slope", slope).withColumns({"slope": F.round("_slope", 3), "rapid": (F.col("_slope") >= threshold) & (F.col(count) >= least_count)}).drop("_s", "_slope")
