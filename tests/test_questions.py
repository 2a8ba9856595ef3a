import json
from datetime import datetime, timedelta, timezone

import pytest

from watchline.questions.answers import answer, parsed, refusal
from watchline.questions.times import time_span

NOW = datetime(2026, 8, 23, 15, 30, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("text", "start", "end", "kind"),
    [
        ("last 30 minutes", (23, 15, 0), (23, 15, 30), "relative"),
        ("between 1 and 5 pm", (23, 13, 0), (23, 17, 0), "absolute"),
        ("from 11 pm to 2 am yesterday", (22, 23, 0), (23, 2, 0), "absolute"),
        ("at 3 pm", (23, 15, 0), (23, 16, 0), "absolute"),
        ("yesterday evening", (22, 17, 0), (22, 21, 0), "day_part"),
        ("last night", (22, 21, 0), (23, 0, 0), "day_part"),
        ("yesterday", (22, 0, 0), (23, 0, 0), "day"),
        ("today", (23, 0, 0), (23, 15, 30), "day"),
    ],
)
def test_spans(text, start, end, kind):
    got = time_span(f"what was seen {text}?", NOW)
    assert (got.start, got.end, got.kind) == (NOW.replace(day=start[0], hour=start[1], minute=start[2]), NOW.replace(day=end[0], hour=end[1], minute=end[2]), kind)


def test_no_span_and_offset():
    assert time_span("track 17?", NOW) is None
    assert time_span("at 3 pm", NOW, 60).start.hour == 14


@pytest.mark.parametrize(("text", "kind"), [("Who is this?", "identity"), ("any gun?", "weapon"), ("hostile intent", "intent"), ("same person on cam 2", "cross_camera_identity"), ("SELECT * from events", "sql"), ("How long did track 17 stay?", None)])
def test_refusals(text, kind):
    assert (refusal(text) or (None,))[0] == kind


@pytest.mark.parametrize(("text", "intent"), [("hello!", "greeting"), ("busiest camera now", "busiest_camera"), ("When did track 17 enter?", "track_entry"), ("track 17", "track_story"), ("who crossed the fence", "crossings"), ("anything at cam-2", "camera_summary")])
def test_intents(text, intent):
    assert parsed(text, NOW).intent == intent


def test_answers(spark):
    t0 = datetime(2026, 8, 23, 10, 15)
    rows = [("ZONE", "entered", 0.0, 0), ("ZONE", "loitering", 10.0, 10), ("ZONE", "exited", 25.0, 25), ("ALERT", None, None, 0)]
    data = [(i, f"e{i}", kind, t0 + timedelta(seconds=s), "cam_1", "17", "person", json.dumps({"transition": move, "dwell_duration_seconds": dwell})) for i, (kind, move, dwell, s) in enumerate(rows)]
    events = spark.createDataFrame(data, "seq_id long, event_id string, event_type string, timestamp timestamp, camera_id string, local_track_id string, entity_type string, metadata string")
    got = answer("How long did track 17 remain?", events, NOW)
    assert got.status == "answered" and got.facts[0] == "longest dwell 25.0 s"
    assert answer("When did track 17 enter?", events, NOW).evidence[0]["event_id"] == "e0"
    assert answer("When did track 99 enter?", events, NOW).status == "no_records_found"
    assert answer("how many people are there", events, NOW).facts == ["cam_1: 1 tracks"]
    assert answer("who is this", events, NOW).grounding == "refusal"
    assert answer("how many cameras are active", events, NOW, cameras=spark.createDataFrame([("cam_1", "ONLINE"), ("cam_2", "OFFLINE")], "camera_id string, status string")).facts == ["cam_1: ONLINE, 1 tracks", "cam_2: OFFLINE, 0 tracks"]


def test_zone_story_counts_all(spark):
    """more zone events than an answer once read."""
    from tests.compare import connection
    from watchline.plans import catalog

    sql = catalog.REGISTRY.sql["nlq21_zone_story"]
    assert "LIMIT" not in sql
    d = "/root/testdata/sf0.01"
    row = catalog.REGISTRY.queries["nlq21_zone_story"](spark, d).first()
    assert row.n > 50 and tuple(row) == connection(d).execute(sql).fetchone()
