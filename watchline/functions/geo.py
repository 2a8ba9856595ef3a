"""Spatial functions on columns. Points and polygon vertices are structs of x and y; y grows downwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchline.functions.numbers import rounded

#: The two frame sizes that normalised coordinates are scaled to.
SMALL_FRAME, LARGE_FRAME = (1280.0, 720.0), (1920.0, 1080.0)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon(vertices: list[tuple[float, float]]) -> Column:
    """A literal polygon."""
    return F.array(*(point(F.lit(float(x)), F.lit(float(y))) for x, y in vertices))


def edges(poly: Column) -> Column:
    """Each vertex with the next one, the last with the first, as structs of a and b."""
    following = F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))
    return F.zip_with(poly, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _scale(x: Column, y: Column, wide: Column, high: Column) -> tuple[Column, Column]:
    """Frame sizes by whether a width and a height exceed the small frame's."""
    return F.when(wide > SMALL_FRAME[0], LARGE_FRAME[0]).otherwise(SMALL_FRAME[0]), F.when(high > SMALL_FRAME[1], LARGE_FRAME[1]).otherwise(SMALL_FRAME[1])


def _crossings(x: Column, y: Column, poly: Column, half_open: bool) -> Column:
    """How many edges a ray to the right of the point crosses, as a column of 0 or 1 (odd)."""

    def hit(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        at = (y - ay) * (bx - ax) / F.nullif(by - ay, F.lit(0.0)) + ax
        if half_open:
            spans = (y > F.least(ay, by)) & (y <= F.greatest(ay, by)) & (x <= F.greatest(ax, bx))
            return spans & ((ax == bx) | (x <= at))
        return ((ay > y) != (by > y)) & (x < at)

    odd = F.aggregate(edges(poly), F.lit(False), lambda inside, e: inside != F.coalesce(hit(e), F.lit(False)))
    return F.coalesce(odd, F.lit(False))


def zone_contains(x: Column, y: Column, poly: Column) -> Column:
    """Whether a zone holds a point (lower edges open, upper closed), matching normalised and pixel coordinates."""
    fits = F.forall(poly, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1))
    wide, high = F.array_max(F.transform(poly, lambda p: p["x"])), F.array_max(F.transform(poly, lambda p: p["y"]))
    down = _scale(x, y, x, y)
    up = _scale(x, y, wide, high)
    shrink, grow = fits & ((x > 1) | (y > 1)), ~fits & (x <= 1) & (y <= 1)
    px = F.when(shrink, x / down[0]).when(grow, x * up[0]).otherwise(x)
    py = F.when(shrink, y / down[1]).when(grow, y * up[1]).otherwise(y)
    return F.coalesce((F.size(poly) >= 3) & _crossings(px, py, poly, True), F.lit(False))


def polygon_contains(x: Column, y: Column, poly: Column) -> Column:
    """Whether a polygon holds a point, by strict comparison with its edges."""
    return F.coalesce((F.size(poly) >= 3) & _crossings(x, y, poly, False), F.lit(False))


def polygon_bounds(poly: Column) -> Column:
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def normalized_polygon(points: Column) -> Column:
    """The polygon without points that miss a coordinate; null if fewer than three are left."""
    valid = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(F.size(valid) >= 3, valid)


def box_meets_polygon(x1: Column, y1: Column, x2: Column, y2: Column, poly: Column) -> Column:
    """Whether a box and a polygon meet: centre, foot or a corner inside, or a vertex in the box.

    Boxes outside the polygon's bounds are turned away first.
    """
    bounds = polygon_bounds(poly)
    apart = (x2 < bounds["x1"]) | (x1 > bounds["x2"]) | (y2 < bounds["y1"]) | (y1 > bounds["y2"])
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    probes = [(cx, cy), (cx, y2), (x1, y1), (x2, y1), (x1, y2), (x2, y2)]
    inside = reduce(lambda a, b: a | b, (polygon_contains(px, py, poly) for px, py in probes))
    vertex = F.exists(poly, lambda p: p["x"].between(x1, x2) & p["y"].between(y1, y2))
    return ~apart & (inside | vertex)


def centroid(poly: Column) -> Column:
    """The mean of the vertices."""
    n = F.size(poly)
    total = lambda c: F.aggregate(poly, F.lit(0.0), lambda s, p: s + p[c])
    return F.struct((total("x") / n).alias("x"), (total("y") / n).alias("y"))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Width, height, area and centre of a box."""
    w, h = x2 - x1, y2 - y1
    return F.struct(w.alias("width"), h.alias("height"), (w * h).alias("area"), ((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where they are apart or empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


#: Direction names, the condition that each demands, and whether the name itself is the answer.
DIRECTIONS = {
    "up": (["NORTH", "UP", "INWARD"], ["NORTH", "INWARD"]),
    "down": (["SOUTH", "DOWN", "OUTWARD"], ["SOUTH", "OUTWARD"]),
    "right": (["EAST", "RIGHT", "LEFT_TO_RIGHT"], ["EAST", "LEFT_TO_RIGHT"]),
    "left": (["WEST", "LEFT", "RIGHT_TO_LEFT"], ["WEST", "RIGHT_TO_LEFT"]),
    "in": (["INBOUND", "A_TO_B"], []),
    "out": (["OUTBOUND", "B_TO_A"], []),
}


def side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """On which side of the line from a to b the point c lies: a positive or negative number, 0 on it."""
    return (cy - ay) * (bx - ax) - (by - ay) * (cx - ax)


def crossing(px: Column, py: Column, x: Column, y: Column, wire: tuple[Column, Column, Column, Column], direction: Column) -> Column:
    """The direction in which the move from (px, py) to (x, y) crosses a wire, or null."""
    ax, ay, bx, by = wire
    unit = ax.between(0, 1) & ay.between(0, 1) & bx.between(0, 1) & by.between(0, 1)
    near = (F.greatest(F.abs(px), F.abs(x)) <= 1) & (F.greatest(F.abs(py), F.abs(y)) <= 1)
    down = _scale(x, y, F.greatest(px, x), F.greatest(py, y))
    up = _scale(x, y, F.greatest(ax, bx), F.greatest(ay, by))
    fit = lambda v, i: F.when(unit & ~near, v / down[i]).when(~unit & near, v * up[i]).otherwise(v)
    fitted = F.struct(fit(px, 0).alias("px"), fit(py, 1).alias("py"), fit(x, 0).alias("x"), fit(y, 1).alias("y"))
    # An array of one, so that the fitted ends are worked out once and the generated code stays small.
    return F.transform(F.array(fitted), lambda m: _crossed(m, wire, unit, direction))[0]


def _crossed(move: Column, wire: tuple[Column, Column, Column, Column], unit: Column, direction: Column) -> Column:
    """``crossing`` of a move whose ends are in the wire's units."""
    ax, ay, bx, by = wire
    px, py, x, y = (move[c] for c in ("px", "py", "x", "y"))
    d1, d2 = side(ax, ay, bx, by, px, py), side(ax, ay, bx, by, x, y)
    d3, d4 = side(px, py, x, y, ax, ay), side(px, py, x, y, bx, by)
    proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    far = F.hypot(x - px, y - py) >= F.when(unit, 0.0015).otherwise(2.5)
    wanted = F.upper(F.trim(F.coalesce(direction, F.lit("BIDIRECTIONAL"))))
    inbound = d1 > 0
    moves = {"up": y < py, "down": y > py, "right": x > px, "left": x < px, "in": inbound, "out": ~inbound}
    allowed = F.lit(True)
    echoed: list[str] = []
    for kind, (names, own) in DIRECTIONS.items():
        allowed = F.when(wanted.isin(names), moves[kind]).otherwise(allowed)
        echoed += own
    answer = F.when(wanted.isin(echoed), wanted).when(inbound, "inbound").otherwise("outbound")
    return F.when(proper & far & allowed, answer)


def closing(x: Column, y: Column, vx: Column, vy: Column, segment: tuple[Column, Column, Column, Column], fps: float = 30.0) -> Column:
    """Distance to a segment and speed towards it in pixels a second, both rounded to a tenth."""
    way = to_segment(x, y, segment)
    return closing_by(way["tx"], way["ty"], vx, vy, way["point_like"], fps)


def to_segment(x: Column, y: Column, segment: tuple[Column, Column, Column, Column]) -> Column:
    """The way from a point to the nearest point of a segment, and whether that is but a point."""
    ax, ay, bx, by = segment
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    point_like = length < 1e-6
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / F.nullif(length, F.lit(0.0))))
    way = lambda p, a, d: F.when(point_like, a - p).otherwise(a + t * d - p)
    return F.struct(way(x, ax, dx).alias("tx"), way(y, ay, dy).alias("ty"), point_like.alias("point_like"))


def closing_by(tx: Column, ty: Column, vx: Column, vy: Column, point_like: Column, fps: float = 30.0) -> Column:
    """What ``closing`` gives, by the way that ``to_segment`` gives."""
    distance = F.hypot(tx, ty)
    speed = (vx * tx + vy * ty) / F.nullif(distance, F.lit(0.0)) * fps
    at = ~point_like & (distance < 1e-4)
    return F.struct(
        F.when(point_like, distance).when(at, 0.0).otherwise(rounded(distance, 1)).alias("distance"),
        F.when(point_like | at, 0.0).otherwise(rounded(speed, 1)).alias("speed"),
    )


def is_closing(distance: Column, closing_speed: Column, speed: Column, most: float = 350.0, least: float = 25.0) -> Column:
    return (speed >= 0.5) & (distance <= most) & (closing_speed >= least)


def cosine_2d(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of two plane vectors within -1 and 1; 0 if either is shorter than 1e-4."""
    a, b = F.hypot(ax, ay), F.hypot(bx, by)
    value = (ax * bx + ay * by) / F.nullif(a * b, F.lit(0.0))
    return F.when((a < 1e-4) | (b < 1e-4), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, with 1e-9 added to the product of their lengths."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)
