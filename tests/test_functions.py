"""Literal expectations for spatial, movement, scoring and text functions."""

import random

import pytest
from pyspark.sql import functions as F

from watchline.functions import geo, kinematics, numbers, scoring, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(*values):
    return [F.lit(float(v)) for v in values]


SQUARE = [(100, 100), (300, 100), (300, 300), (100, 300)]


@pytest.mark.parametrize(("x", "y", "inside"), [(200, 200, True), (150, 150, True), (50, 50, False), (400, 200, False), (200, 350, False)])
def test_containment(spark, x, y, inside):
    assert value(spark, geo.zone_contains(*lit(x, y), geo.polygon(SQUARE))) is inside
    assert value(spark, geo.polygon_contains(*lit(x, y), geo.polygon(SQUARE))) is inside


def test_normalised_polygon_and_pixels(spark):
    unit = geo.polygon([(0.1, 0.1), (0.5, 0.1), (0.5, 0.5), (0.1, 0.5)])
    assert value(spark, geo.zone_contains(*lit(300, 200), unit)) is True
    assert value(spark, geo.zone_contains(*lit(1000, 200), unit)) is False
    assert value(spark, geo.zone_contains(*lit(1, 1), geo.polygon([(0, 0), (1, 1)]))) is False


@pytest.mark.parametrize(
    ("wire", "move", "direction", "answer"),
    [
        ((100, 200, 500, 200), (300, 180, 300, 220), "BIDIRECTIONAL", "outbound"),
        ((100, 300, 500, 300), (200, 250, 200, 350), "SOUTH", "SOUTH"),
        ((100, 300, 500, 300), (200, 350, 200, 250), "SOUTH", None),
        ((400, 100, 400, 300), (350, 200, 450, 200), "EAST", "EAST"),
        ((400, 100, 400, 300), (450, 200, 350, 200), "EAST", None),
        ((100, 200, 500, 200), (300, 199.5, 300, 200.5), "BIDIRECTIONAL", None),
    ],
)
def test_crossing(spark, wire, move, direction, answer):
    got = value(spark, geo.crossing(*lit(*move), tuple(lit(*wire)), F.lit(direction)))
    assert got == answer or (direction == "BIDIRECTIONAL" and answer and got in ("inbound", "outbound"))


def test_boxes(spark):
    assert value(spark, F.round(geo.iou(tuple(lit(100, 100, 260, 300)), tuple(lit(104, 98, 264, 302))), 3)) == pytest.approx(0.933, abs=0.01)
    assert value(spark, geo.iou(tuple(lit(0, 0, 1, 1)), tuple(lit(2, 2, 3, 3)))) == 0
    assert value(spark, geo.box_meets_polygon(*lit(250, 250, 400, 400), geo.polygon(SQUARE))) is True
    assert value(spark, geo.box_meets_polygon(*lit(310, 310, 400, 400), geo.polygon(SQUARE))) is False
    assert value(spark, geo.box_meets_polygon(*lit(50, 50, 400, 400), geo.polygon(SQUARE))) is True


@pytest.mark.parametrize(("vy", "speed"), [(10, 300.0), (-10, -300.0)])
def test_closing(spark, vy, speed):
    got = value(spark, geo.closing(*lit(500, 300, 0, vy), tuple(lit(100, 400, 900, 400))))
    assert (got.distance, got.speed) == (100.0, speed)


@pytest.mark.parametrize(("a", "b", "cosine"), [((10, 0), (15, 0), 1), ((10, 0), (-10, 0), -1), ((10, 0), (0, 10), 0), ((0, 0), (1, 1), 0)])
def test_cosine(spark, a, b, cosine):
    assert value(spark, geo.cosine_2d(*lit(*a, *b))) == pytest.approx(cosine)


def test_headings(spark):
    for degrees, name in zip(range(0, 360, 45), ["E", "SE", "S", "SW", "W", "NW", "N", "NE"], strict=True):
        assert value(spark, kinematics.cardinal(F.lit(float(degrees)))) == name
    assert value(spark, kinematics.report_cardinal(F.lit(45.0))) == "NE"
    assert value(spark, kinematics.report_cardinal(F.lit(0.0))) is None


def test_movement(spark):
    points = geo.polygon([(100, 100), (120, 100), (140, 100)])
    got = value(spark, kinematics.movement(points))
    assert got.is_moving and got.cardinal_heading == "E" and got.distance_px == 40.0 and got.speed_px_per_frame == 20.0
    assert value(spark, kinematics.movement(geo.polygon([(1, 1)]))).cardinal_heading == "STATIONARY"
    turn = geo.polygon([(0, 0), (10, 0), (20, 0), (30, 0), (30, 0), (20, 0), (10, 0), (0, 0)])
    assert value(spark, kinematics.turns_abruptly(turn)) is True
    pacing = geo.polygon([(10 * (i % 8 if i % 8 < 4 else 8 - i % 8), 0) for i in range(32)])
    assert value(spark, kinematics.oscillates(pacing)) is True
    assert value(spark, kinematics.oscillates(points)) is False


@pytest.mark.parametrize(("speed", "label"), [(0.5, "Stationary"), (25, "Slow Moving (Rel)"), (60, "Moderate (Rel)"), (150, "Fast Moving (Rel)")])
def test_speed_label(spark, speed, label):
    assert value(spark, kinematics.speed_label(F.lit(float(speed)), F.lit(speed < 1))) == label


def test_calibrated_speed(spark):
    assert value(spark, kinematics.speed_label(F.lit(100.0), F.lit(False), F.lit(0.024))) == "~2.4 m/s (calibrated)"


def test_threat(spark):
    yes = F.lit(True)
    assert value(spark, scoring.threat({}))[:2] == (0.0, "NORMAL")
    assert value(spark, scoring.threat({"restricted_intrusion": yes}))[:2] == (35.0, "RESTRICTED")
    got = value(spark, scoring.threat({"restricted_intrusion": yes, "tripwire_breach": yes, "night_movement": yes, "towards_protected": yes}))
    assert (got.score, got.level, len(got.reasons)) == (95.0, "CRITICAL", 4)


def test_plausibility(spark):
    def score(same, linked, configured, elapsed):
        edge = lit(5, 30, 10, 1.0) if linked else [F.lit(None).cast("double")] * 4
        return value(spark, scoring.transition_plausibility(F.lit(same), F.lit(linked), F.lit(configured), F.lit(float(elapsed)), *edge))

    assert score(True, False, True, 10) == (True, 1.0)
    assert score(False, True, True, 10) == (True, 1.0)
    assert score(False, True, True, 0.5) == (False, 0.1)
    assert score(False, False, True, 10) == (False, 0.05)
    assert score(False, False, False, 10) == (True, 0.7)


def test_plates_and_ids(spark):
    assert value(spark, text.plate(F.lit(" mh12 ab 1234 "))) == "MH12AB1234"
    assert value(spark, text.confusable(F.lit("MH12AB1234"), F.lit("MHI2A81234"))) is False
    assert value(spark, text.confusable(F.lit("MH12AB1234"), F.lit("MHI2AB12E4"))) is True
    assert value(spark, text.entity_id(F.lit("person-7"))) == "GLOBAL-PERSON-007"
    assert value(spark, text.class_named(F.lit("two People at the gate"))) == "person"
    assert value(spark, text.masked_credentials(F.lit("rtsp://a:b@h/x"))) == "rtsp://***:***@h/x"


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_half_even_is_what_python_rounds_to(spark, digits):
    rng = random.Random(digits)
    values = [2.675, -2.675, 0.5, 1.5, 2.5, 0.125, 0.375, 1.005, 0.0, -0.0, 1e-9, 4.35, 1e15 + 0.5, 2.0**53, -7.0, 0.0049999]
    values += [rng.randrange(-40000, 40000) / rng.choice([8, 16, 200, 400, 1000, 2000]) for _ in range(400)] + [rng.uniform(-1e6, 1e6) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)) + [(-1, None)], "i int, x double")
    got = {r.i: r.r for r in df.select("i", numbers.half_even(F.col("x"), digits).alias("r")).collect()}
    assert got.pop(-1) is None
    assert [(i, v, got[i]) for i, v in enumerate(values) if got[i] != round(v, digits)] == []


def test_words_in_questions(spark):
    df = spark.createDataFrame([("Where is TRACK # 12?", "12", None), ("track id", None, None), ("cam-7b and track all", None, "cam-7b"), ("camera id 9", None, "cam_9")], "q string, track string, camera string")
    assert df.where(~text.track_named(F.col("q")).eqNullSafe(F.col("track")) | ~text.camera_named(F.col("q")).eqNullSafe(F.col("camera"))).count() == 0


def test_rounding_by_the_product(spark):
    """340.4 / 184 is a little under 1.85, but ten times that is 18.5."""
    for x, digits, wanted in [(340.4 / 184, 1, 1.9), (-340.4 / 184, 1, -1.9), (0.04, 1, 0.0), (2.5, 0, 3.0), (1e300, 1, 1e300), (None, 1, None)]:
        assert value(spark, numbers.rounded(F.lit(x).cast("double"), digits)) == wanted


def test_turn_of_a_right_angle(spark):
    """headings a right angle apart whose difference as doubles is a little less."""
    plain = lambda a, b: abs((b - a + 180) % 360 - 180)
    for a, b in ((i / 10, j / 10) for i in range(3600) for j in (i - 900, i + 2700) if 0 <= j < 3600):
        if plain(a, b) < 90 <= abs(((b - a + 180) % 360 + 360) % 360 - 180):
            assert value(spark, kinematics.turn(F.lit(a), F.lit(b))) >= 90
            return
    raise AssertionError("no such heading")
