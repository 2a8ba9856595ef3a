"""Questions to answers: guards first, then the first intent whose words occur, then its query."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchline.functions.text import VEHICLES
from watchline.operators import events as ev
from watchline.operators import reports
from watchline.questions.times import Span, time_span

#: What is refused, by words, with the status of the answer. The order counts.
REFUSALS = [
    ("identity", "unsupported_capability", ["who is this", "who is track", "what is their name", "what is his name", "what is her name", "identify face", "facial recognition", "is that john", "identify person", "identity of track", "identity of person"]),
    ("weapon", "unsupported_capability", ["weapon", "gun", "knife", "armed", "firearm", "pistol", "rifle", "bomb", "explosive"]),
    ("intent", "unsupported_capability", ["intent", "planning to attack", "planning an attack", "planning attack", "plan an attack", "is he suspicious", "is this suspicious", "what are they planning", "criminal intent", "hostile intent"]),
    ("cross_camera_identity", "unsupported_capability", ["same person on", "same track on camera", "cross-camera", "same individual on"]),
    ("sql", "invalid_query", ["select *", "drop table", "union select", "insert into", "delete from", "update "]),
]
#: Intents by words, in the order in which they are tried; "track" intents need a track in the question.
INTENTS = [
    ("live_cameras", False, ["how many camera", "active camera", "list camera", "camera status", "which camera", "cameras online"]),
    ("live_people", False, ["how many people", "people detected", "people visible", "person detected", "how many person", "pedestrians"]),
    ("live_vehicles", False, ["how many car", "how many vehicle", "cars detected", "vehicles detected", "cars visible", "vehicles visible"]),
    ("busiest_camera", False, ["most active", "most activity", "highest activity", "which camera has the most", "busiest camera"]),
    ("threat_status", False, ["under threat", "current threat", "threat status", "is the system under threat", "defcon"]),
    ("breaches", False, ["any perimeter breach", "perimeter breaches", "any breaches", "security breaches"]),
    ("recent_history", False, ["what happened", "recent events", "last few minutes", "recent activity"]),
    ("zones", False, ["what zone", "configured zone", "list zone", "active zone", "active tripwire", "configured tripwire", "list tripwire"]),
    ("system_status", False, ["system status", "system health", "live performance", "current fps", "system metrics"]),
    ("follow_entity", False, ["global-person", "global-vehicle", "global-entity", "person-", "vehicle-", "follow track", "where was person", "which cameras did person", "cameras did"]),
    ("track_entry", True, ["enter", "entry"]),
    ("track_exit", True, ["leave", "left", "exit"]),
    ("track_dwell", True, ["how long", "dwell", "remain", "loiter"]),
    ("track_movement", True, ["direction", "heading", "speed", "moving", "where"]),
    ("track_story", True, [""]),
    ("alert_explanation", False, ["alert", "incident", "breach"]),
    ("threat_status", False, ["threat score", "threat", "defcon", "elevated"]),
    ("vehicles", False, ["vehicle", "car", "truck", "plate", "anpr"]),
    ("night", False, ["night", "tonight", "dark"]),
    ("crossings", False, ["boundary", "cross", "tripwire", "fence"]),
    ("highest_risk", False, ["highest", "most critical", "evidence"]),
    ("zone_story", False, ["who entered", "in zone"]),
    ("camera_summary", False, [""]),
]
#: Seconds that an intent looks back when the question names no time.
LOOK_BACK = {"threat_status": 300, "recent_history": 600}
GREETING = re.compile(r"^(hi|hello|hey|help|good\s+(morning|afternoon|evening)|howdy|greetings|who are you|what can you do)[\s!.,?]*$")
TRACK = re.compile(r"\btrack\s*#?\s*(\d+)", re.I)
ENTITY = re.compile(r"\b(?:global-)?(person|vehicle)-(\d+)", re.I)
CAMERA = re.compile(r"\b(cam[-_ ]?[\w-]*\d[\w-]*)", re.I)


@dataclass(frozen=True)
class QuerySpec:
    """What a question asks for."""

    intent: str
    track: str | None = None
    camera: str | None = None
    span: Span | None = None
    entity: str | None = None


@dataclass
class Answer:
    question: str
    status: str
    grounding: str
    facts: list[str] = field(default_factory=list)
    evidence: list[dict] = field(default_factory=list)
    unknowns: list[str] = field(default_factory=list)


def refusal(question: str) -> tuple[str, str] | None:
    """The kind and status of the first refusal whose words occur."""
    low = question.lower()
    return next(((kind, status) for kind, status, words in REFUSALS if any(w in low for w in words)), None)


def parsed(question: str, now: datetime, camera: str | None = None) -> QuerySpec:
    low = question.lower().strip()
    track = m[1] if (m := TRACK.search(question)) else None
    camera = camera or (m[1].upper().replace(" ", "-") if (m := CAMERA.search(question)) and not m[1].lower().startswith("camera") else None)
    intent = "greeting" if GREETING.match(low) else next(name for name, needs, words in INTENTS if (track or not needs) and any(w in low for w in words))
    span = time_span(question, now)
    if span is None and intent in LOOK_BACK:
        span = Span(now - timedelta(seconds=LOOK_BACK[intent]), now, "default")
    entity = f"GLOBAL-{m[1].upper()}-{int(m[2]):03d}" if (m := ENTITY.search(question)) else None
    return QuerySpec(intent, track, camera, span, entity)


def refusal_kind(text: Column) -> Column:
    """The kind of the first refusal whose words a question holds, or null."""
    low = F.lower(text)
    holds = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), low.contains)
    return F.coalesce(*(F.when(holds(words), F.lit(kind)) for kind, _, words in REFUSALS))


def is_greeting(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(GREETING.pattern)


def live(events: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``camera_id, n``: tracks last seen as one of ``kinds`` (null: any), by camera."""
    last = events.groupBy("camera_id", "local_track_id").agg(F.max_by("entity_type", F.struct("timestamp", "seq_id")).alias("entity_type"))
    last = last.where(F.col("entity_type").isin(kinds)) if kinds else last
    return last.groupBy("camera_id").agg(F.count("local_track_id").alias("n"))


def payload(path: str) -> Column:
    return F.get_json_object("metadata", f"$.{path}")


def assessed(events: DataFrame, now: datetime, seconds: float) -> DataFrame:
    """The threat to all cameras together over the ``seconds`` before ``now``: one row, or none without any event."""
    words = {c: payload(c) for c in ("message", "narrative", "transition", "zone_name", "zone_severity", "severity")}
    rows = events.where(F.col("timestamp") <= F.lit(now)).withColumns({"sector": F.lit("all")} | words)
    return reports.sector_assessment(rows, "sector", "local_track_id", "timestamp", "seq_id", F.lit(now), seconds)


def fleet(workers: DataFrame) -> DataFrame:
    """Sums and means over the running workers (running, display_fps, ai_fps, active_tracks, frames_processed); zeros without any."""
    run = workers.where("running")
    mean = lambda c: F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = run.agg(F.count("*").alias("workers_running"), total("active_tracks"), total("frames_processed"), mean("display_fps"), mean("ai_fps"))
    return workers.agg(F.count("*").alias("workers")).crossJoin(sums)  # one row each


def last_movement(rows: DataFrame) -> DataFrame:
    """Where a track was last, how fast and which way, of its tracking events."""
    last = ev.typed(rows, "TRACKING").agg(F.max_by(F.struct("seq_id", "p"), F.struct("timestamp", "seq_id")).alias("e")).where("e IS NOT NULL").select("e.*")
    p = F.col("p")
    return last.select("seq_id", p["position"][0].alias("x"), p["position"][1].alias("y"), p["velocity"][0].alias("vx"), p["velocity"][1].alias("vy"), p["speed"].alias("speed"), p["direction"].alias("direction"))


def summary_for(spec: QuerySpec, events: DataFrame, now: datetime | None = None, cameras: DataFrame | None = None, zones: DataFrame | None = None, workers: DataFrame | None = None) -> DataFrame | None:
    """What answers those intents that aren't answered by single events; None for others.

    Cameras (camera_id, status), zones and tripwires (kind, zone_id, name, severity, is_active) and workers are tables of
    what is configured; where they aren't given, the events tell what has been seen of them.
    """
    rows = rows_for(spec, events)
    if spec.intent == "live_cameras" and cameras is not None:
        seen = live(events)
        return cameras.join(seen, "camera_id", "left").select("camera_id", "status", F.coalesce("n", F.lit(0)).alias("n")).orderBy("camera_id")
    if spec.intent in ("live_cameras", "live_people", "live_vehicles"):
        return live(events, {"live_people": ["person"], "live_vehicles": VEHICLES}.get(spec.intent)).orderBy(F.desc("n"), "camera_id")
    if spec.intent == "busiest_camera":
        return live(events).orderBy(F.desc("n"), "camera_id").limit(1)
    if spec.intent == "threat_status" and now is not None:
        return assessed(events, now, (spec.span.end - spec.span.start).total_seconds())
    if spec.intent == "zones" and zones is not None:
        return zones.orderBy("kind", "zone_id")
    if spec.intent == "zones":
        return events.where(F.col("zone_id").isNotNull()).groupBy("zone_id").agg(F.count("*").alias("n")).orderBy("zone_id")
    if spec.intent == "system_status" and workers is not None:
        return fleet(workers)
    if spec.intent == "system_status":
        return events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("camera_id").alias("cameras"), F.max("seq_id").alias("last")).orderBy("event_type")
    if spec.intent == "follow_entity" and (spec.entity or spec.track):
        own = F.col("global_entity_id") == spec.entity if spec.entity else F.col("local_track_id") == spec.track
        hops = events.where(own).withColumn("entity", F.lit(spec.entity or spec.track))
        return reports.journeys(hops, "entity", "camera_id", "timestamp", "seq_id").orderBy("hop")
    if spec.intent == "track_movement":
        return last_movement(rows)
    if spec.intent == "vehicles":
        seen = rows.where(payload("object_class").isin(VEHICLES)).withColumn("object_class", payload("object_class"))
        return ev.last_by(seen, ["local_track_id"], "object_class", "timestamp", "seq_id").orderBy("local_track_id")
    if spec.intent == "zone_story":
        return rows.agg(F.count("*").alias("n"), F.countDistinct("local_track_id").alias("tracks")).where("n > 0")
    if spec.intent == "camera_summary":
        return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).orderBy("event_type")
    return None


def rows_for(spec: QuerySpec, events: DataFrame) -> DataFrame | None:
    """The events (F1 columns) that answer a question, few and in order, or all that are counted; None for questions without any."""
    newest = lambda df, n: ev.newest_in_order(df, "timestamp", "seq_id", n)
    rows = events
    if spec.camera:
        rows = rows.where(F.col("camera_id") == spec.camera)
    if spec.track:
        rows = rows.where(F.col("local_track_id") == spec.track)
    if spec.span:
        rows = rows.where(F.col("timestamp").between(F.lit(spec.span.start), F.lit(spec.span.end)))
    zone, alert = F.col("event_type") == "ZONE", F.col("event_type") == "ALERT"
    moves = lambda *kinds: zone & payload("transition").isin(*kinds)
    filters: dict[str, tuple[Column, int | None]] = {
        "track_entry": (moves("entered"), 1000),
        "track_exit": (moves("exited"), 1000),
        "track_dwell": (zone, 1000),
        "track_movement": (F.col("event_type") == "TRACKING", 1000),
        "track_story": (F.lit(True), 100),
        "alert_explanation": (alert, 5),
        "breaches": (alert, 10),
        "highest_risk": (alert, 1),
        "threat_status": (alert | zone, 200),
        "recent_history": (F.lit(True), 10),
        "vehicles": (F.col("event_type") == "TRACKING", 100),
        "night": (alert & F.lower(F.coalesce(payload("message"), F.lit(""))).rlike("night|dark"), 20),
        "crossings": (moves("crossed"), 2000),
        "zone_story": (zone, None),  # counted whole
        "camera_summary": (F.lit(True), 100),
    }
    if spec.intent not in filters:
        return None
    condition, limit = filters[spec.intent]
    return rows.where(condition) if limit is None else newest(rows.where(condition), limit)


def told(spec: QuerySpec, row: dict) -> str:
    """A row of ``summary_for`` as a fact."""
    one = {
        "follow_entity": "{hop}: {camera} from {arrived} to {left}",
        "threat_status": "threat {level} at {score}: {critical} critical, {restricted} restricted, {loitering} loitering, {tracks} tracks",
        "track_movement": "last at ({x}, {y}), moving by ({vx}, {vy}) at {speed} pixels a frame, direction {direction}",
        "vehicles": "track {local_track_id}: {last_object_class}",
        "zone_story": "{tracks} tracks in {n} zone events",
        "camera_summary": "{event_type}: {n} events from {first} to {last}",
    }
    if spec.intent in one:
        return one[spec.intent].format(**row)
    if spec.intent in ("live_cameras", "live_people", "live_vehicles", "busiest_camera"):
        return f"{row['camera_id']}: " + (f"{row['status']}, " if "status" in row else "") + f"{row['n']} tracks"
    first = next(iter(row))
    return f"{row[first]}: " + ", ".join(f"{name} {value}" for name, value in row.items() if name != first)


def answer(question: str, events: DataFrame, now: datetime, camera: str | None = None, **tables: DataFrame) -> Answer:
    """A refusal, or the facts that the intent's tables and events give; only their bounded rows come to the driver."""
    if refused := refusal(question):
        return Answer(question, refused[1], "refusal", unknowns=[refused[0]])
    spec = parsed(question, now, camera)
    if spec.intent == "greeting":
        return Answer(question, "answered", "grounded", facts=["Ask about tracks, zones, alerts, cameras or times."])
    counted = summary_for(spec, events, now, **tables)
    if counted is not None:
        facts = [told(spec, r.asDict()) for r in counted.limit(100).collect()]
        return Answer(question, "answered" if facts else "no_records_found", "grounded" if facts else "no_data", facts=facts)
    rows = rows_for(spec, events)
    found = [r.asDict() for r in rows.collect()] if rows is not None else []
    if not found:
        return Answer(question, "no_records_found", "no_data", unknowns=[spec.intent])
    kinds = sorted({r["event_type"] for r in found})
    facts = [f"{sum(r['event_type'] == k for r in found)} {k} events" for k in kinds]
    if spec.intent == "track_dwell":
        dwell = rows.agg(F.max(payload("dwell_duration_seconds").cast("double"))).first()[0]
        facts.insert(0, f"longest dwell {dwell or 0.0:.1f} s")
    return Answer(question, "answered", "grounded", facts=facts, evidence=[{k: r[k] for k in ("event_id", "event_type", "timestamp", "camera_id")} for r in found[:10]])
