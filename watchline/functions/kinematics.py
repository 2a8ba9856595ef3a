"""Movement functions on columns. Trajectories are arrays of structs of x and y, oldest first; 0 degrees is east."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchline.functions.numbers import rounded

#: Eight headings from east, clockwise in the image; and from north, for reports.
HEADINGS = ["E", "SE", "S", "SW", "W", "NW", "N", "NE"]
REPORT_HEADINGS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def _sector(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), (F.pmod(number, F.lit(8)) + 1).cast("int"))


def cardinal(degrees: Column, stationary: Column | None = None) -> Column:
    """The heading of eight whose 45 degrees hold the angle."""
    name = _sector(HEADINGS, F.floor((F.pmod(degrees, F.lit(360.0)) + 22.5) / 45))
    return name if stationary is None else F.when(stationary, "STATIONARY").otherwise(name)


def report_cardinal(degrees: Column) -> Column:
    """The heading of eight from north; a null or zero angle has none."""
    return F.when(degrees != 0, _sector(REPORT_HEADINGS, F.bround(degrees / 45)))


def wrapped(degrees: Column) -> Column:
    """Degrees from 0 up to 360, by the sum that SQL forms: it rounds 269.99999999999994 to 270, which ``pmod`` leaves."""
    return (degrees % 360.0 + 360.0) % 360.0


def angle(dx: Column, dy: Column) -> Column:
    """Degrees from 0 up to 360."""
    return wrapped(F.degrees(F.atan2(dy, dx)))


def turn(a: Column, b: Column) -> Column:
    """Degrees between two headings, 0 to 180."""
    return F.abs(wrapped(b - a + 180) - 180)


def displacement(points: Column) -> Column:
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when(F.size(points) > 0, F.hypot(last["x"] - first["x"], last["y"] - first["y"])).otherwise(0.0)


def movement(points: Column, fps: float = 30.0, window: int = 5, least: float = 1.0) -> Column:
    """Displacement, speed and heading over the last ``window`` points of a trajectory."""
    recent = F.slice(points, F.greatest(F.size(points) - window + 1, F.lit(1)), F.lit(window))
    short = F.coalesce(F.size(points) < 2, F.lit(True))
    first, last = F.element_at(recent, 1), F.element_at(recent, -1)
    frames = F.greatest(F.size(recent) - 1, F.lit(1))
    dx, dy = last["x"] - first["x"], last["y"] - first["y"]
    distance = F.hypot(dx, dy)
    still = short | (distance < least * frames) | (distance == 0)
    per_frame = F.round(distance / frames, 2)
    # An array of one, so that the angle is worked out once and the generated code stays small.
    heading = F.transform(F.array(angle(dx, dy)), lambda a: rounded(a, 1))[0]
    or_zero = lambda c: F.when(short, 0.0).otherwise(c)
    return F.struct(
        or_zero(F.round(dx / frames, 2)).alias("dx"),
        or_zero(F.round(dy / frames, 2)).alias("dy"),
        or_zero(F.round(distance, 2)).alias("distance_px"),
        F.when(still, 0.0).otherwise(heading).alias("direction_deg"),
        F.when(still, "STATIONARY").otherwise(cardinal(heading)).alias("cardinal_heading"),
        or_zero(per_frame).alias("speed_px_per_frame"),
        or_zero(F.round(per_frame * fps, 2)).alias("speed_px_per_sec"),
        (~still).alias("is_moving"),
    )


def speed_label(speed: Column, stationary: Column, meters_per_pixel: Column | None = None) -> Column:
    """An operator's label: metres a second if calibrated, else a relative class."""
    label = F.when(stationary | (speed < 2), "Stationary")
    if meters_per_pixel is not None:
        label = label.when(meters_per_pixel > 0, F.concat(F.lit("~"), F.round(speed * meters_per_pixel, 1).cast("string"), F.lit(" m/s (calibrated)")))
    return label.when(speed > 120, "Fast Moving (Rel)").when(speed > 40, "Moderate (Rel)").otherwise("Slow Moving (Rel)")


def moves_towards(x: Column, y: Column, heading: Column, tx: Column, ty: Column, tolerance: float = 50.0) -> Column:
    """Whether a heading points at a target within a tolerance; true within five pixels of it."""
    return (F.hypot(tx - x, ty - y) < 5) | (turn(heading, angle(tx - x, ty - y)) <= tolerance)


def turns_abruptly(points: Column, window: int = 4, least: float = 90.0) -> Column:
    """Whether the headings of the last two windows, both moving, differ by ``least`` degrees or more."""
    n = F.size(points)
    part = lambda back: F.slice(points, F.greatest(n - back * window + 1, F.lit(1)), F.lit(window))
    a, b = movement(part(2), least=2.0), movement(part(1), least=2.0)
    sharp = a["is_moving"] & b["is_moving"] & (turn(a["direction_deg"], b["direction_deg"]) >= least)
    return F.coalesce((n >= 2 * window) & sharp, F.lit(False))


def oscillates(points: Column, stride: int = 4, reversals: int = 2) -> Column:
    """Whether every ``stride``-th point shows at least so many turns of over 110 degrees."""
    sampled = F.filter(points, lambda p, i: i % stride == 0)
    n = F.size(sampled)
    steps = F.zip_with(F.slice(sampled, 1, F.greatest(n - 1, F.lit(0))), F.slice(sampled, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))
    headings = F.transform(F.filter(steps, lambda s: F.hypot(s["dx"], s["dy"]) > 2), lambda s: angle(s["dx"], s["dy"]))
    k = F.size(headings)
    turns = F.zip_with(F.slice(headings, 1, F.greatest(k - 1, F.lit(0))), F.slice(headings, 2, F.greatest(k - 1, F.lit(0))), turn)
    return F.coalesce((F.size(points) >= 16) & (n >= 4) & (k >= 3) & (F.size(F.filter(turns, lambda t: t > 110)) >= reversals), F.lit(False))
