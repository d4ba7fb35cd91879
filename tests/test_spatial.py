import math

import numpy as np
import pytest

from parapet.operators import spatial as S


def _distance(a, b):
    lat1, lat2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * S.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("lat", [0.0, 42.0, -63.0, 80.0])
def test_nearest_equals_brute_force_at_any_latitude(spark, lat):
    rng = np.random.default_rng(int(abs(lat)))
    spread = 0.004
    places = [(i, float(rng.uniform(-71, -71 + spread / math.cos(math.radians(lat)))), float(rng.uniform(lat, lat + spread))) for i in range(200)]
    # A third of all buildings share one address, a third of all targets another.
    places = [(i, *(places[0][1:] if i % 3 == 0 else p)) for i, *p in places]
    targets = [(i, float(rng.uniform(-71, -71 + spread / math.cos(math.radians(lat)))), float(rng.uniform(lat, lat + spread))) for i in range(150)]
    targets = [(i, *(targets[1][1:] if i % 3 == 0 else t)) for i, *t in targets]
    got = S.nearest_within(
        spark.createDataFrame(places, "build_id int, longitude double, latitude double"),
        spark.createDataFrame(targets, "permit_id int, longitude double, latitude double"), 30.0, "permit_id",
    ).collect()
    expected = {}
    for i, *p in places:
        near = sorted((round(_distance(p, t), 6), j) for j, *t in targets)
        if near[0][0] <= 30.0:
            expected[i] = near[0][1]
    assert len(expected) > 5 and {r.build_id: r.permit_id for r in got} == expected and len(got) == len(expected)


def test_match_rules_with_copies(spark):
    boxes = S.box_around(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0), (4, 2.0, 2.0), (5, 3.0, 3.0)],
                                               "build_id int, longitude double, latitude double"), 0.00003)
    points = spark.createDataFrame(
        [(10, 6, 0.0, 0.0), (11, 1, 1.0, 1.0), (12, 6, 1.0, 1.0), (13, 6, 1.00001, 1.0), (14, 1, 2.0, 2.0)],
        "point_id int, type_no int, longitude double, latitude double")
    got = {(r.build_id, r.rule) for r in S.matches(boxes, points).collect()}
    assert got == {(1, "single"), (2, "single"), (3, "multi"), (4, "nearest")}
    votes = S.footprint_votes(points, boxes)
    assert S.multi_unit_votes(votes).first().occ_dict == "AGR: 0, COM: 1, EDU: 0, GOV: 0, IND: 0, REL: 0, RES: 2"
    rate = S.match_rate(boxes, points).first()
    assert (rate.matched, rate.total, rate.match_rate) == (4, 5, 80.0)


def test_boxes_across_cells_match_each_point_once(spark):
    boxes = spark.createDataFrame([(1, -0.0025, 0.0025, -0.0015, 0.0015)], "build_id int, lon_min double, lon_max double, lat_min double, lat_max double")
    points = spark.createDataFrame([(i, 0, x, 0.0) for i, x in enumerate([-0.0025, -0.001, 0.0, 0.001, 0.0025, 0.0026])],
                                   "point_id int, type_no int, longitude double, latitude double")
    assert sorted(r.point_id for r in S.point_in_footprint(points, boxes).collect()) == [0, 1, 2, 3, 4]


def test_polygons(spark):
    concave = [(0.0, 0.0), (0.4, 0.0), (0.4, 0.4), (0.2, 0.1), (0.0, 0.4)]
    shapes = spark.createDataFrame([(1, concave), (2, [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1)])],
                                   "polygon_id int, corners array<struct<lon:double,lat:double>>")
    places = spark.createDataFrame([(1, 0.05, 0.05), (2, 0.2, 0.3), (3, 0.39, 0.3), (4, 0.5, 0.1), (5, None, 0.1)],
                                   "build_id int, longitude double, latitude double")
    assert sorted(r.build_id for r in S.inside_polygons(places, shapes).collect()) == [1, 3]


def test_dominant_component(spark):
    parts = spark.createDataFrame([("a", "x", 40, 2), ("a", "b", 40, 3), ("a", "c", 20, 1), ("z", None, 5, 9)],
                                  "mukey string, compname string, comppct_r int, cokey int")
    got = {r.mukey: (r.compname, r.comppct_r) for r in S.dominant_components(parts).collect()}
    assert got == {"a": ("b", 40), "z": (None, 5)}


def test_nearest_across_the_date_line(spark):
    places = [(1, 179.99999, 10.0), (2, -179.99999, 10.0), (3, 180.0, 0.0), (4, 179.0, 0.0)]
    targets = [(7, -179.99999, 10.0), (8, 179.99998, 60.0), (9, -179.9999, 0.0)]
    got = S.nearest_within(
        spark.createDataFrame(places, "build_id int, longitude double, latitude double"),
        spark.createDataFrame(targets, "permit_id int, longitude double, latitude double"), 30.0, "permit_id",
    ).collect()
    assert {(r.build_id, r.permit_id, round(r.distance_m, 1)) for r in got} == {(1, 7, 2.2), (2, 7, 0.0), (3, 9, 11.1)}


def test_polygons_with_holes_and_parts(spark):
    box = lambda x, y, half: [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]
    rings = [box(0.0, 0.0, 0.2), box(0.0, 0.0, 0.1), box(0.0, 0.0, 0.03), box(0.5, 0.0, 0.1)]
    shapes = spark.createDataFrame([(1, rings)], "polygon_id int, rings array<array<struct<lon:double,lat:double>>>")
    rng = np.random.default_rng(3)
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.3, 0.7, (400, 2)))]
    inside = lambda x, y, cx, half: abs(x - cx) < half and abs(y) < half
    expected = sorted(
        i for i, x, y in places
        if (inside(x, y, 0.0, 0.2) and not inside(x, y, 0.0, 0.1)) or inside(x, y, 0.0, 0.03) or inside(x, y, 0.5, 0.1)
    )
    found = S.inside_polygons(spark.createDataFrame(places, "build_id int, longitude double, latitude double"), shapes).collect()
    assert sorted(r.build_id for r in found) == expected and 30 < len(expected) < 200


def _even_odd(px, py, rings):
    """Even-odd rule by a ray to the east over all edges, in numpy."""
    inside = np.zeros(len(px), bool)
    for ring in rings:
        a = np.asarray(ring, float)
        for (ax, ay), (bx, by) in zip(a, np.roll(a, -1, axis=0)):
            if ay != by:
                spans = (ay > py) != (by > py)
                inside ^= spans & (px < ax + (bx - ax) * ((py - ay) / (by - ay)))
    return inside


def _found(spark, places, rings, **more):
    shapes = spark.createDataFrame([(1, [[(float(x), float(y)) for x, y in r] for r in rings])], "polygon_id int, rings array<array<struct<lon:double,lat:double>>>")
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "build_id int, longitude double, latitude double")
    return sorted(r.build_id for r in S.inside_polygons(df, shapes, **more).collect())


def test_polygon_of_a_hundred_thousand_corners(spark):
    rng = np.random.default_rng(8)
    n = 100_000
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    reach = 1.2 + 0.3 * np.sin(9 * angle) + rng.normal(0, 0.004, n)
    ring = np.column_stack((reach * np.cos(angle) - 70, reach * np.sin(angle) + 42))
    places = rng.uniform(-1.7, 1.7, (3000, 2)) + (-70, 42)
    px, py = places.T
    inside = np.zeros(len(px), bool)
    for start in range(0, n, 4000):
        a, b = ring[start:start + 4000], np.roll(ring, -1, axis=0)[start:start + 4000]
        spans = (a[:, 1] > py[:, None]) != (b[:, 1] > py[:, None])
        at = a[:, 0] + (b[:, 0] - a[:, 0]) * ((py[:, None] - a[:, 1]) / (b[:, 1] - a[:, 1]))
        inside ^= (spans & (px[:, None] < at)).sum(1) % 2 == 1
    assert _found(spark, places, [ring]) == np.flatnonzero(inside).tolist() and 1000 < inside.sum() < 2000
    # Edges are dealt to the cells they touch, and cells inside have none.
    shapes = spark.createDataFrame([([[(float(x), float(y)) for x, y in ring]],)], "rings array<array<struct<lon:double,lat:double>>>")
    cells = S.polygon_cells(shapes, S.LAND_CELL).selectExpr("size(edges) AS n", "odd").collect()
    assert sum(c.n for c in cells) < 1.1 * n and sum(c.n == 0 for c in cells) > 300 and all(c.odd for c in cells if c.n == 0)


def test_points_on_corners_and_borders(spark):
    """Corners, edges and points on multiples of a cell's side, so that every test meets its equal case."""
    side = S.LAND_CELL
    rng = np.random.default_rng(2)
    for _ in range(6):
        ring = rng.integers(-6, 7, (rng.integers(3, 9), 2)) * side / rng.choice([1, 2])
        grid = np.array([(x, y) for x in range(-14, 15) for y in range(-14, 15)]) * side / 2
        assert _found(spark, grid, [ring]) == np.flatnonzero(_even_odd(*grid.T, [ring])).tolist(), ring.tolist()


def test_rings_that_touch_and_cross(spark):
    rng = np.random.default_rng(4)
    rings = [rng.uniform(-0.5, 0.5, (12, 2)), rng.integers(-8, 9, (30, 2)) * 0.05, [(0.0, 0.0), (0.3, 0.0), (0.3, 0.0), (0.3, 0.3), (0.0, 0.3)]]
    places = np.vstack([rng.uniform(-0.6, 0.6, (1500, 2)), rng.integers(-12, 13, (500, 2)) * 0.05])
    want = np.flatnonzero(_even_odd(*places.T, rings)).tolist()
    assert _found(spark, places, rings) == want == _found(spark, places, rings, cell=0.5) and len(want) > 300


def test_equal_polygons_and_no_polygon(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    kind = "polygon_id int, corners array<struct<lon:double,lat:double>>"
    places = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5)], "build_id int, longitude double, latitude double")
    twice = spark.createDataFrame([(1, square), (1, square), (2, square), (3, None), (4, [])], kind)
    assert [r.build_id for r in S.inside_polygons(places, twice).collect()] == [1]
    assert S.inside_polygons(places, spark.createDataFrame([], kind)).count() == 0


def _all_nearest(places, targets, radius):
    p, t = np.array([x[1:] for x in places]), np.array([x[1:] for x in targets])
    lon1, lat1, lon2, lat2 = (np.radians(x) for x in (p[:, :1], p[:, 1:], t[:, 0], t[:, 1]))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    d = np.round(2 * S.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h))), 6)
    out = {}
    for i, row in enumerate(d):
        best = min((x, targets[j][0]) for j, x in enumerate(row))
        if best[0] <= radius:
            out[places[i][0]] = best[1]
    return out


def _nearest(spark, places, targets, radius, **more):
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, longitude double, latitude double")
    rows = S.nearest_within(frame(places, "build_id"), frame(targets, "permit_id"), radius, "permit_id", **more).collect()
    assert len(rows) == len({r.build_id for r in rows})
    return {r.build_id: r.permit_id for r in rows}


@pytest.mark.parametrize("centre", [(0.0, 90.0), (77.0, -90.0), (180.0, 12.0), (-71.0, 42.0), (0.0, 0.0)])
def test_nearest_at_poles_and_date_line(spark, centre):
    """Places around a pole lie on all longitudes, those at the date line on both sides of it."""
    rng = np.random.default_rng(6)
    lon, lat = centre

    def around(n):
        out = []
        for i in range(n):
            if abs(lat) == 90:
                out.append((i, float(rng.uniform(-180, 180)), float(lat - np.sign(lat) * abs(rng.normal(0, 0.0008)))))
            else:
                x = lon + rng.normal(0, 0.0006)
                out.append((i, float(x - 360 if x > 180 else x), float(lat + rng.normal(0, 0.0006))))
        return out

    places, targets = [*around(150), (900, lon, lat)], [*around(100), (901, lon, lat)]
    want = _all_nearest(places, targets, 30.0)
    assert _nearest(spark, places, targets, 30.0) == want and 50 < len(want) and want[900] == 901
    if centre[1] == 12.0:
        assert any(p[1] < 0 < targets[want[p[0]]][1] for p in places if want.get(p[0], 901) != 901)


def test_nearest_in_a_dense_place(spark):
    """Crowded cells are searched by smaller radii first; the results are the same."""
    rng = np.random.default_rng(9)
    spot = lambda n, spread: [(float(-71 + rng.normal(0, spread)), float(42 + rng.normal(0, spread))) for _ in range(n)]
    places = [(i, *p) for i, p in enumerate(spot(300, 0.00002) + spot(200, 0.0004))]
    targets = [(i, *p) for i, p in enumerate(spot(400, 0.00003) + spot(100, 0.0006))]
    want = _all_nearest(places, targets, 30.0)
    frame = spark.createDataFrame([t[1:] for t in targets], "t_lon double, t_lat double")
    assert len(S._radii(frame, 30.0, 20)) > 2 and S._radii(frame, 30.0, 1000) == [30.0]
    assert _nearest(spark, places, targets, 30.0, crowd=20) == want == _nearest(spark, places, targets, 30.0) and len(want) > 400


def test_crowded_cells_are_split(spark):
    """Boxes of all sizes over a dense place: those that cover a cell, those that border it, and points on borders."""
    rng = np.random.default_rng(3)
    side = S.BOX_CELL
    points = [(float(x), float(y)) for x, y in rng.normal(0.3 * side, 0.2 * side, (500, 2))] + [(float(x), float(y)) for x, y in rng.integers(-3, 4, (60, 2)) * side / 8]
    points = sorted(set(points))
    boxes = []
    for i in range(120):
        x, y = rng.normal(0.3 * side, 0.5 * side, 2) if i % 3 else rng.integers(-8, 9, 2) * side / 8
        half = side * 10 ** rng.uniform(-2.5, 0.6) if i % 3 else side * rng.integers(1, 9) / 8
        boxes.append((i, float(x - half), float(x + half), float(y - half), float(y + half)))
    want = sorted((p, b[0]) for p in points for b in boxes if b[1] <= p[0] <= b[2] and b[3] <= p[1] <= b[4])
    p = spark.createDataFrame(points, "longitude double, latitude double")
    b = spark.createDataFrame(boxes, "box int, lon_min double, lon_max double, lat_min double, lat_max double")
    for crowd in (10, 100, 10_000):
        got = sorted(((r.longitude, r.latitude), r.box) for r in S.contained(p, b, crowd=crowd).collect())
        assert got == want and len(want) > 5000, crowd


def test_pairs_of_crowded_places_are_dealt(spark):
    """The number of pairs, not of rows read, decides how many tasks share them; borders, copies and signed zeros count."""
    from pyspark.sql import functions as F

    from parapet.operators import spatial

    n = 300
    points = spark.range(n).select(F.col("id").alias("point_id"), F.lit(1).alias("type_no"), F.expr("CASE WHEN id%2=0 THEN 0.0D ELSE -0.0D END").alias("longitude"), F.lit(5.0).alias("latitude"))
    points = points.unionByName(spark.createDataFrame([(n, 2, 9.0, 5.0), (n + 1, 3, None, 5.0), (n + 2, 3, 9.0, 50.0)], "point_id long, type_no int, longitude double, latitude double"))
    boxes = spark.range(n).select(F.col("id").alias("build_id"), F.expr("CASE WHEN id%3=0 THEN 0.0D ELSE -0.0D END").alias("lon_min"), F.lit(0.001).alias("lon_max"), F.lit(4.9995).alias("lat_min"), F.lit(5.0).alias("lat_max"))
    boxes = boxes.unionByName(spark.createDataFrame([(n, 9.0, 9.0, 5.0, 5.0), (None, 9.0, 9.0, 5.0, 5.0), (7, None, 9.0, 5.0, 5.0)], "build_id long, lon_min double, lon_max double, lat_min double, lat_max double"))
    found = spatial.point_in_footprint(points, boxes, task_pairs=2_000)
    each = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(each) == n * n + 2 and max(each) < n * n / 4
    assert found.where("point_id < 300 AND build_id < 300").distinct().count() == n * n
    assert sorted(((r.point_id, r.build_id) for r in found.where("point_id >= 300").collect()), key=str) == [(n, n), (n, None)]
