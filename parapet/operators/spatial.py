"""Proximity joins on a grid: equal cells first, the exact test on the candidates after.

Positions that occur many times (copies of a point, many buildings at one address) are
reduced to one before the candidate join, so a crowded place never yields all its pairs.
The joins back to the buildings are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions.numbers import percent
from parapet.staging import stage

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0
# Vote types by number, and the radii of the two proximity rules.
POINT_TYPES = ("AGR", "COM", "EDU", "GOV", "IND", "REL", "RES")
RESIDENTIAL = POINT_TYPES.index("RES")
NEAREST_POINT_M = 5.0
PERMIT_RADIUS_M = 30.0
# Side of a cell of boxes in degrees (a power of two); rows of a cell that is not split further, the parts of a side, and how often.
BOX_CELL = 1 / 1024
CROWD, SPLIT, DEEPEST = 4096, 8, 4
# Pairs of points and footprints that a task gives out.
TASK_PAIRS = 4_000_000
# Side of a cell of the polygon index in degrees (a power of two), and what its edges are widened by.
LAND_CELL, HAIR = 0.0625, 1e-9


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def box_around(df: DataFrame, half: float) -> DataFrame:
    """Footprints as boxes of ``half`` degrees around the position."""
    return df.withColumns({
        "lon_min": F.col("longitude") - half, "lon_max": F.col("longitude") + half,
        "lat_min": F.col("latitude") - half, "lat_max": F.col("latitude") + half,
    })


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def _cover(low: str, high: str, size: float) -> Column:
    return F.explode(F.sequence(_cell(F.col(low), size), _cell(F.col(high), size)))


def _inside() -> Column:
    return F.col("longitude").between(F.col("lon_min"), F.col("lon_max")) & F.col("latitude").between(F.col("lat_min"), F.col("lat_max"))


def contained(points: DataFrame, boxes: DataFrame, cell: float = BOX_CELL, crowd: int = CROWD) -> DataFrame:
    """Every (point, box) with the point inside, borders included.

    Boxes are copied to the cells they touch; a point lies in one cell, so no pair repeats. A cell with more
    than ``crowd`` points is split in SPLIT x SPLIT, and again while that holds: boxes that cover the whole cell meet its
    points there, where every pair is a result, and only those whose border passes it go down to its parts. ``cell`` is a power
    of two, so that parts nest exactly.
    """
    own = [c for c in boxes.columns if c not in points.columns and c not in ("lon_min", "lon_max", "lat_min", "lat_max")]
    tiles = boxes.withColumn("cx", _cover("lon_min", "lon_max", cell)).withColumn("cy", _cover("lat_min", "lat_max", cell))
    tiles = tiles.select("cx", "cy", "lon_min", "lon_max", "lat_min", "lat_max", *own)
    at = lambda df, size: df.withColumns({"cx": _cell(F.col("longitude"), size), "cy": _cell(F.col("latitude"), size)})
    located = at(stage(points, "points"), cell)
    meet = lambda some, around: some.join(around, ["cx", "cy"]).where(_inside()).drop("cx", "cy")
    out = []
    for _ in range(DEEPEST):
        crowded = located.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("cx", "cy")
        if crowded.isEmpty():
            break
        crowded = stage(crowded, "crowded-cells")
        west, south = F.col("cx") * cell, F.col("cy") * cell
        covers = (F.col("lon_min") <= west) & (F.col("lon_max") >= west + cell) & (F.col("lat_min") <= south) & (F.col("lat_max") >= south + cell)
        out.append(meet(located.join(crowded, ["cx", "cy"], "left_anti"), tiles))
        located, tiles = (df.join(crowded, ["cx", "cy"], "left_semi") for df in (located, tiles))
        out.append(meet(located, tiles.where(covers)))
        finer = cell / SPLIT
        parts = {}
        for c, low, high in (("cx", "lon_min", "lon_max"), ("cy", "lat_min", "lat_max")):
            first = F.greatest(_cell(F.col(low), finer), F.col(c) * SPLIT)
            last = F.least(_cell(F.col(high), finer), F.col(c) * SPLIT + (SPLIT - 1))
            parts[c] = F.explode(F.sequence(first, last))
        border = stage(tiles.where(~F.coalesce(covers, F.lit(False))), "border-tiles")
        tiles = border.withColumn("cx", parts["cx"]).withColumn("cy", parts["cy"])
        located, cell = at(stage(located.select(*points.columns), "points"), finer), finer
    out.append(meet(located, tiles))
    return reduce(DataFrame.unionByName, out)


def point_in_footprint(points: DataFrame, footprints: DataFrame, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(point_id, build_id, type_no) of every point inside a footprint.

    Repeated positions and boxes meet once. Copies of a place make a result far larger than the tables, so its rows are
    counted first: their number, not that of the bytes read, decides how many tasks there are, and a box with
    more than ``task_pairs`` of them is dealt to several by its points.
    """
    edges = ["lon_min", "lon_max", "lat_min", "lat_max"]
    points = stage(points.select("point_id", "type_no", "longitude", "latitude"), "points")
    places = points.groupBy("longitude", "latitude").agg(F.count(F.lit(1)).alias("n_points"))
    boxes = footprints.groupBy(*edges).agg(F.count(F.lit(1)).alias("n_boxes"))
    # Written, so that a box keeps its number.
    boxes = stage(boxes.withColumn("box", F.monotonically_increasing_id()), "boxes")
    hits = stage(contained(places, boxes), "box-hits")
    pairs = F.sum(F.col("n_points") * F.col("n_boxes"))
    tasks = (hits.agg(pairs.alias("n")).first()[0] or 0) // task_pairs
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    sliced = stage(hits.groupBy("box").agg(F.ceil(pairs / task_pairs).cast("long").alias("slices")), "box-slices")
    located = hits.select("longitude", "latitude", "box").join(sliced, "box").join(points, ["longitude", "latitude"])
    located = located.select("box", F.pmod(F.xxhash64("point_id"), F.col("slices")).alias("slice"), "point_id", "type_no").repartition(parts, "box", "slice")
    owners = footprints.select("build_id", *edges).join(boxes.join(sliced, "box"), edges)
    owners = owners.select("box", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "build_id").repartition(parts, "box", "slice")
    return located.join(owners, ["box", "slice"]).select("point_id", "build_id", "type_no")


def footprint_votes(points: DataFrame, footprints: DataFrame) -> DataFrame:
    """Per footprint with points inside: the number of points of each type and the lowest point id.

    Points are counted per position first and footprints are taken once per box, so copies
    cost one candidate each.
    """
    kinds = [F.count_if(F.col("type_no") == i).alias(f"t{i}") for i in range(len(POINT_TYPES))]
    places = points.groupBy("longitude", "latitude").agg(*kinds, F.min("point_id").alias("first_point"))
    edges = ["lon_min", "lon_max", "lat_min", "lat_max"]
    hits = contained(places, footprints.select(*edges).distinct())
    sums = [F.sum(f"t{i}").alias(f"t{i}") for i in range(len(POINT_TYPES))]
    per_box = hits.groupBy(*edges).agg(*sums, F.min("first_point").alias("first_point"))
    votes = footprints.select("build_id", *edges).join(per_box, edges).drop(*edges)
    return votes.withColumn("n_points", sum((F.col(f"t{i}") for i in range(1, len(POINT_TYPES))), F.col("t0")))


def vote_rule() -> Column:
    """The rule by which a footprint's points match it: single, multi, or null."""
    single = (F.col("n_points") == 1) & (F.col(f"t{RESIDENTIAL}") == 1)
    return F.when(single, "single").when(F.col("n_points") > 1, "multi")


def single_home_matches(votes: DataFrame) -> DataFrame:
    """Footprints that hold exactly one point, a residential one."""
    return votes.where(vote_rule() == "single").select("build_id", F.col("first_point").alias("point_id"))


def multi_unit_votes(votes: DataFrame) -> DataFrame:
    """Footprints with several points, and their points per type as a vote string."""
    parts = [F.concat(F.lit(f"{code}: "), F.col(f"t{i}").cast("string")) for i, code in enumerate(POINT_TYPES)]
    many = votes.where(vote_rule() == "multi")
    return many.select("build_id", "n_points", F.concat_ws(", ", *parts).alias("occ_dict"))


def _cube_cells(lon: Column, lat: Column, around: float, side: float) -> dict[str, Column]:
    """The cells of ``side`` metres that a ball of ``around`` metres touches, per axis as first and last; for 0 both are the point's own.

    Positions are points of space, so the poles and the date line are places like any other.
    """
    lon, lat = F.radians(lon), F.radians(lat)
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    return {f"{end}_{axis}": F.floor((c * EARTH_RADIUS_M + sign * around) / side) for axis, c in axes.items() for end, sign in (("first", -1), ("last", 1))}


CUBE = ["c_x", "c_y", "c_z"]


def _own_cells(df: DataFrame, lon: str, lat: str, side: float) -> DataFrame:
    cells = _cube_cells(F.col(lon), F.col(lat), 0.0, side)
    return df.withColumns({f"c_{axis}": cells[f"first_{axis}"] for axis in "xyz"})


def _nearest_round(spots: DataFrame, near: DataFrame, radius_m: float, target_id: str) -> DataFrame:
    """(longitude, latitude, _best) of the spots with a target within ``radius_m``."""
    # A chord is never longer than its arc; a little more for rounding.
    reach = radius_m * 1.001
    ends = _cube_cells(F.col("t_lon"), F.col("t_lat"), reach, 4 * reach)
    for axis in "xyz":
        near = near.withColumn(f"c_{axis}", F.explode(F.sequence(ends[f"first_{axis}"], ends[f"last_{axis}"])))
    distance = F.round(haversine(F.col("longitude"), F.col("latitude"), F.col("t_lon"), F.col("t_lat")), 6)
    pairs = _own_cells(spots, "longitude", "latitude", 4 * reach).join(near, CUBE).withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m)
    return pairs.groupBy("longitude", "latitude").agg(F.min(F.struct("distance_m", target_id)).alias("_best"))


def _radii(near: DataFrame, radius_m: float, crowd: int) -> list[float]:
    """The radius, and before it smaller ones where cells hold more than ``crowd`` targets, each a quarter of the next."""
    out = [radius_m]
    while len(out) <= DEEPEST:
        counts = _own_cells(near, "t_lon", "t_lat", 4 * out[0] * 1.001).groupBy(*CUBE).agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= crowd:
            break
        out.insert(0, out[0] / 4)
    return out


def nearest_within(places: DataFrame, targets: DataFrame, radius_m: float, target_id: str, crowd: int = CROWD) -> DataFrame:
    """Per row of ``places`` with a target within ``radius_m``: the nearest one, ties to the lower id.

    Space is cut into cubes four radii wide. Targets, the smaller side, are copied to the cells their
    ball touches: eight at most, and three to four on average. Where cells are crowded, smaller radii with smaller
    cells come first: whoever finds a target there has found the nearest, and only the others look farther.
    """
    spots = places.select("longitude", "latitude").distinct()
    near = stage(targets.groupBy(F.col("longitude").alias("t_lon"), F.col("latitude").alias("t_lat")).agg(F.min(target_id).alias(target_id)), "targets")
    found, radii = [], _radii(near, radius_m, crowd)
    if len(radii) > 1:
        spots = stage(spots, "spots")
    for radius in radii:
        left = reduce(lambda df, done: df.join(done, ["longitude", "latitude"], "left_anti"), found, spots)
        best = _nearest_round(left, near, radius, target_id)
        found.append(best if radius == radius_m else stage(best, "nearest"))
    best = reduce(DataFrame.unionByName, found)
    return places.join(best, ["longitude", "latitude"]).select(
        *[c for c in places.columns if c not in ("longitude", "latitude")], "longitude", "latitude",
        F.col(f"_best.{target_id}").alias(target_id), F.col("_best.distance_m").alias("distance_m"),
    )


def nearest_for_unmatched(footprints: DataFrame, points: DataFrame, matched: DataFrame) -> DataFrame:
    """The nearest point within five metres for footprints whose ``build_id`` is not in ``matched``."""
    left = footprints.select("build_id", "longitude", "latitude").join(matched.select("build_id"), "build_id", "left_anti")
    return nearest_within(left, points, NEAREST_POINT_M, "point_id").select("build_id", "point_id", "distance_m")


def rule_matches(footprints: DataFrame, points: DataFrame) -> DataFrame:
    """Footprints matched by the first two rules: (build_id, rule)."""
    votes = footprint_votes(points, footprints)
    return votes.select("build_id", vote_rule().alias("rule")).where("rule IS NOT NULL")


def matches(footprints: DataFrame, points: DataFrame) -> DataFrame:
    """All matched footprints and the rule that matched them: single, multi or nearest.

    Points are read by all three rules, and the first two rules are needed twice, as matches and to leave
    them out of the third, so both are staged.
    """
    points = stage(points.select("point_id", "type_no", "longitude", "latitude"), "points")
    ruled = stage(rule_matches(footprints, points), "rule-matches")
    near = nearest_for_unmatched(footprints, points, ruled).select("build_id", F.lit("nearest").alias("rule"))
    return ruled.unionByName(near)


def match_rate(footprints: DataFrame, points: DataFrame) -> DataFrame:
    """Matched and total footprints and the rate in percent, two decimals."""
    found = matches(footprints, points).select("build_id", F.lit(1).alias("hit"))
    joined = footprints.select("build_id").join(found, "build_id", "left")
    return joined.agg(
        F.count("hit").alias("matched"), F.count(F.lit(1)).alias("total"),
        percent(F.count("hit"), F.count(F.lit(1))).alias("match_rate"),
    )


def dominant_components(components: DataFrame) -> DataFrame:
    """Per map unit the component with the largest share, ties by name then key.

    An aggregate, not a ranking, so a unit with very many components is reduced map-side.
    """
    order = F.struct((-F.col("comppct_r")).alias("share"), F.col("compname").alias("name"), F.col("cokey").alias("key"))
    best = components.where(F.col("mukey").isNotNull() & F.col("comppct_r").isNotNull()).groupBy("mukey").agg(F.min(order).alias("_best"))
    return best.select(
        "mukey", F.col("_best.key").alias("cokey"), F.col("_best.name").alias("compname"),
        (-F.col("_best.share")).alias("comppct_r"),
    )


def with_dominant_component(buildings: DataFrame, components: DataFrame) -> DataFrame:
    """Buildings with the dominant component of their map unit, null where there is none."""
    dominant = dominant_components(components).select(
        "mukey", F.col("compname").alias("dominant_component"), F.col("comppct_r").alias("dominant_share")
    )
    return buildings.join(dominant, "mukey", "left")


def demolitions(buildings: DataFrame, permits: DataFrame, radius_m: float = PERMIT_RADIUS_M) -> DataFrame:
    """Buildings with a demolition permit within the radius, and the nearest such permit."""
    return nearest_within(buildings.select("build_id", "longitude", "latitude"), permits, radius_m, "permit_id").select(
        "build_id", "permit_id", "distance_m"
    )


def _edges(corners: Column) -> Column:
    """The edges of a closed ring as structs of two corners."""
    ends = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    return F.transform(F.arrays_zip(corners.alias("a"), ends.alias("b")), lambda e: F.struct(
        e["a"]["lon"].alias("ax"), e["a"]["lat"].alias("ay"), e["b"]["lon"].alias("bx"), e["b"]["lat"].alias("by")))


def _spans(edge: Column, lat: Column) -> Column:
    """Whether an edge passes a latitude; its lower end counts, its upper end doesn't."""
    return (edge["ay"] > lat) != (edge["by"] > lat)


def _passes_at(edge: Column, lat: Column) -> Column:
    """The longitude at which an edge passes a latitude, never beyond its ends."""
    at = edge["ax"] + (edge["bx"] - edge["ax"]) * F.try_divide(lat - edge["ay"], edge["by"] - edge["ay"])
    return F.greatest(F.least(at, F.greatest(edge["ax"], edge["bx"])), F.least(edge["ax"], edge["bx"]))


def polygon_cells(polygons: DataFrame, cell: float) -> DataFrame:
    """(polygon, cx, cy, odd, edges): the cells that a polygon's edges touch, each with those edges, and the cells inside.

    ``odd`` tells whether the south-east corner of the cell lies inside. For that, edges are cut at the grid's
    latitudes; between each second and third of the sorted cuts of a line, corners are outside. An edge is dealt only to
    the cells it touches, so an index row holds the edges of its cell and none for a cell that needs no ray.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("corners")
    # Equal polygons count once; the key only holds a polygon's rows together.
    shapes = polygons.select(rings.alias("rings")).distinct().select(
        F.md5(F.to_json("rings")).alias("polygon"), F.flatten(F.transform("rings", _edges)).alias("edges"))
    # A step of its own, so that the key is made once per polygon and not once per edge.
    edges = shapes.select("polygon", F.explode("edges").alias("edge"))
    edge = F.col("edge")
    low, high = F.least(edge["ay"], edge["by"]), F.greatest(edge["ay"], edge["by"])
    left, right = F.least(edge["ax"], edge["bx"]), F.greatest(edge["ax"], edge["bx"])

    rows = edges.withColumn("cy", F.explode(F.sequence(_cell(low, cell), _cell(high, cell))))
    # A hair more than the stretch inside the row, so that rounding never leaves out a cell.
    ends = [_passes_at(edge, F.greatest(low, F.col("cy") * cell)), _passes_at(edge, F.least(high, (F.col("cy") + 1) * cell))]
    flat = edge["ay"] == edge["by"]
    first, last = F.when(flat, left).otherwise(F.least(*ends)) - HAIR, F.when(flat, right).otherwise(F.greatest(*ends)) + HAIR
    touched = rows.withColumn("cx", F.explode(F.sequence(_cell(first, cell), _cell(last, cell))))

    # Lines y = cy * cell that an edge passes.
    line, end = F.ceil(low / cell), F.ceil(high / cell) - 1
    cuts = edges.where(line <= end).withColumn("cy", F.explode(F.sequence(line, end))).withColumn("at", _passes_at(edge, F.col("cy") * cell))
    order = Window.partitionBy("polygon", "cy").orderBy("at")
    pairs = cuts.select("polygon", "cy", "at", F.lead("at").over(order).alias("upto"), F.row_number().over(order).alias("i")).where("i % 2 = 1")
    # Corners x = (cx + 1) * cell with at <= x < upto.
    corner, end = F.ceil(F.col("at") / cell) - 1, F.ceil(F.col("upto") / cell) - 2
    inner = pairs.where(corner <= end).withColumn("cx", F.explode(F.sequence(corner, end)))
    both = touched.select("polygon", "cx", "cy", F.lit(False).alias("odd"), "edge").unionByName(
        inner.select("polygon", "cx", "cy", F.lit(True).alias("odd"), F.lit(None).cast(edges.schema["edge"].dataType).alias("edge"))
    )
    return both.groupBy("polygon", "cx", "cy").agg(F.max("odd").alias("odd"), F.collect_list("edge").alias("edges"))


def _in_cell(lon: Column, lat: Column, cx: Column, cy: Column, odd: Column, edges: Column, cell: float) -> Column:
    """Ray casting inside a cell: east to its border, then south along the border to the corner whose side is known.

    Every test of an edge against the path uses the same longitude of the same edge, so the
    result is that of a ray that passes all edges, also for points on corners or borders.
    """
    border, floor = (cx + 1) * cell, cy * cell

    def crosses(edge: Column) -> Column:
        here, there = _passes_at(edge, lat), _passes_at(edge, floor)
        east = _spans(edge, lat) & (lon < here) & (here <= border)
        rising = (edge["bx"] > edge["ax"]) == (edge["by"] > edge["ay"])
        # Whether the edge meets the border at a latitude or below it.
        under = lambda at, y: F.when(_spans(edge, y), F.when(rising, at > border).otherwise(at <= border)).otherwise(edge["ay"] <= y)
        south = ((edge["ax"] > border) != (edge["bx"] > border)) & under(here, lat) & ~under(there, floor)
        return east != south

    return (F.size(F.filter(edges, crosses)) % 2 == 1) != odd


def inside_polygons(buildings: DataFrame, polygons: DataFrame, cell: float = LAND_CELL) -> DataFrame:
    """Buildings that lie in at least one polygon, each once.

    A polygon has one ring of ``corners``, or several ``rings``: parts and their holes, told
    apart by the even-odd rule. Polygons are cut into the cells of :func:`polygon_cells`, which makes the
    semi join an equi-join; a building only meets the edges of its own cell. ``cell`` is a
    power of two, so that cell borders are exact.
    """
    located = buildings.where("longitude IS NOT NULL AND latitude IS NOT NULL").withColumns({
        "_cx": _cell(F.col("longitude"), cell), "_cy": _cell(F.col("latitude"), cell),
    })
    same = (F.col("_cx") == F.col("cx")) & (F.col("_cy") == F.col("cy"))
    inside = _in_cell(F.col("longitude"), F.col("latitude"), F.col("cx"), F.col("cy"), F.col("odd"), F.col("edges"), cell)
    return located.join(polygon_cells(polygons, cell), same & inside, "left_semi").drop("_cx", "_cy")
