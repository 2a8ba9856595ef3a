"""Joins within frames against all pairs, and that their plans keep no more than they need."""

from itertools import combinations

from watchline.operators import joins, plates
from watchline.plans import catalog

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df) -> int:
    """Rows that the query's shuffles wrote."""
    df.collect()
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        name = p.nodeName()
        if name == "Exchange":
            found += p.metrics().apply("shuffleRecordsWritten").value()
        if name == "AdaptiveSparkPlan" or name.endswith("QueryStage"):
            left.append(p.executedPlan() if name == "AdaptiveSparkPlan" else p.plan())
        else:
            left += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_each_pair_once(spark):
    """pairs of one cell and of touching ones, copies at one place, places below 0; no side is broadcast before its rows are multiplied."""
    at = [(i, i % 2, float(i * 37 % 200 - 100), float(i * 91 % 150 - 60)) for i in range(60)] + [(60, 0, 3.0, 3.0), (61, 0, 3.0, 3.0), (62, 0, None, 3.0)]
    rows = spark.createDataFrame(at, "id long, k long, x double, y double")
    found = joins.frame_pairs(rows, ["k"], "id", "x", "y", 50.0, carry=["x"])
    full = [r for r in at if r[2] is not None]
    wanted = sorted((a[1], a[0], b[0], a[2], b[2]) for a, b in combinations(full, 2) if a[1] == b[1] and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 < 50)
    assert sorted(tuple(r) for r in found.collect()) == wanted
    assert "Broadcast" not in plan(found)
    for name in ("geo09_pairwise_iou", "j10_coordinated_pairs", "j16_ping_pong"):
        assert "Broadcast" not in plan(catalog.REGISTRY.queries[name](spark, SMALL))


def test_boxes_dealt_to_two_strips(spark):
    """F1 of round 4: IoU of boxes shuffles a row three times (two strips, and its own), not six."""
    events = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert events < shuffled(catalog.REGISTRY.queries["geo09_pairwise_iou"](spark, SMALL)) <= 3 * events


def test_pairs_of_strips(spark):
    """F2 of round 4: strips give the pairs that cells do, also below 0 and without a position; coordinated pairs shuffle a row three times, not six."""
    at = [(i, i % 2, float(i * 37 % 200 - 100), float(i * 91 % 150 - 60)) for i in range(60)] + [(60, 0, 3.0, 3.0), (61, 0, 3.0, 3.0), (62, 0, None, 3.0), (63, 0, 3.0, None)]
    rows = spark.createDataFrame(at, "id long, k long, x double, y double")
    full = [r for r in at if None not in r]
    wanted = sorted((a[1], a[0], b[0]) for a, b in combinations(full, 2) if a[1] == b[1] and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 < 50)
    carried = joins.frame_pairs(rows, ["k"], "id", "x", "y", 50.0, carry=["x"], strips=True)
    assert sorted(tuple(r) for r in carried.drop("a_x", "b_x").collect()) == wanted
    assert all(r.a_x == at[r.a][2] and r.b_x == at[r.b][2] for r in carried.collect())
    assert sorted(tuple(r) for r in joins.frame_pairs(rows, ["k"], "id", "x", "y", 50.0, strips=True).collect()) == wanted
    events = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert events < shuffled(catalog.REGISTRY.queries["j10_coordinated_pairs"](spark, SMALL)) <= 3 * events


def test_best_around_another(spark):
    """the best other row, also among copies of one place; pairs are folded by hash, not sorted."""
    at = [(i, i * 13 % 40 * 5.0, i * 7 % 30 * 5.0, float(i % 4)) for i in range(50)] + [(50, 0.0, 0.0, 3.0), (51, 0.0, 0.0, 3.0), (52, 900.0, 0.0, 1.0)]
    rows = spark.createDataFrame([(0, *r) for r in at], "k long, id long, x double, y double, v double")
    found = joins.best_around(rows, ["k"], "id", "x", "y", "v", 20.0)
    near = lambda a, b: a[0] != b[0] and abs(a[1] - b[1]) <= 20 and abs(a[2] - b[2]) <= 20
    wanted = {a[0]: max((b for b in at if near(a, b)), key=lambda b: (b[3], -b[0]))[0] for a in at if any(near(a, b) for b in at)}
    assert {r["id"]: r["best"] for r in found.collect()} == wanted
    assert "SortAggregate" not in plan(catalog.REGISTRY.queries["j18_best_face"](spark, SMALL))


def test_first_track_of_equal_boxes(spark):
    """Equal boxes meet once, each detection still has its track, those without one a null; pairs aren't sorted to be ranked."""
    d = spark.createDataFrame([(0, i, 0.0, 0.0, 10.0, 10.0) for i in range(3)] + [(1, 9, 0.0, 0.0, 10.0, 10.0)], "k long, detection_id long, d_x1 double, d_y1 double, d_x2 double, d_y2 double")
    t = spark.createDataFrame([(0, 7, 2, 0.0, 0.0, 10.0, 10.0), (0, 8, 1, 0.0, 1.0, 10.0, 10.0), (0, 9, 0, 9.0, 9.0, 10.0, 10.0)], "k long, track_id long, track_order long, t_x1 double, t_y1 double, t_x2 double, t_y2 double")
    found = joins.linked_detections(d, t, ["k"])
    assert sorted((r.detection_id, r.track_id) for r in found.collect()) == [(0, 8), (1, 8), (2, 8), (9, None)]
    ranks = [line for line in plan(joins.linked_detections(d, t, ["k"])).splitlines() if "row_number() windowspecdefinition(k" in line]
    assert ranks and all("detection_id" not in line for line in ranks)


def test_surest_plate_of_equal_boxes(spark):
    """equal boxes meet once, each vehicle still has its plate; pairs are folded by hash."""
    v = spark.createDataFrame([(0, i, 0.0, 0.0, 100.0, 100.0) for i in range(3)] + [(1, 9, 0.0, 0.0, 100.0, 100.0), (0, 10, 0.0, 0.0, 5.0, 5.0)], "k long, vehicle_id long, v_x1 double, v_y1 double, v_x2 double, v_y2 double")
    p = spark.createDataFrame([(0, 20, 0.5, 1.0, 1.0, 9.0, 9.0), (0, 21, 0.9, 1.0, 1.0, 9.0, 9.0), (0, 22, 0.9, 2.0, 1.0, 9.0, 9.0), (0, 23, 0.99, 90.0, 1.0, 111.0, 9.0)], "k long, plate_id long, confidence double, p_x1 double, p_y1 double, p_x2 double, p_y2 double")
    found = plates.in_vehicles(v, p, ["k"])
    assert sorted(tuple(r) for r in found.collect()) == [(0, 21), (1, 21), (2, 21)]
    assert "SortAggregate" not in plan(found.select("vehicle_id").distinct())


def test_influx_across_pieces(spark):
    """slopes at the border of two pieces, of few samples and of many, are those of one history; the windows are cut by time."""
    from watchline.operators import reports

    times = [595.0, 598.0, 599.0, 600.0, 601.0] + [1195 + i / 2 for i in range(20)]
    rows = spark.createDataFrame([(1, t, i % 5 + i) for i, t in enumerate(times)], "c long, t double, n long")
    found = reports.influx(rows, ["c"], "t", "n")
    assert found.columns == ["c", "t", "n", "slope", "rapid"] and "_piece" in plan(found)
    samples = {r.t: r.slope for r in found.collect()}
    assert len(samples) == len(times)
    for i, t in enumerate(times):
        s = [(u, j % 5 + j) for j, u in enumerate(times) if j <= i and t - u <= 10][-15:]
        mt, my = sum(u for u, _ in s) / len(s), sum(y for _, y in s) / len(s)
        wanted = sum((u - mt) * (y - my) for u, y in s) / sum((u - mt) ** 2 for u, _ in s) if len(s) >= 3 else 0.0
        assert abs(samples[t] - wanted) < 2e-3
