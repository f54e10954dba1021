"""Radius, nearest, containment and overlap joins on grids; routes, centroids, densities."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.functions import geo
from tidemark.operators import balls
from tidemark.operators.skew import HOT_ROWS, salted_join
from tidemark.operators.windows import neighbour, running_sum
from tidemark.session import cut_lineage

MAX_RADIUS_KM = 10_000.0
CENTER = ["center_id", "center_lat", "center_lon", "qx", "qy", "qz"]


def _distance(method: str):
    return {"geodesic": geo.geodesic_km, "haversine": geo.haversine_km}[method]


def near_box(lat: float, lon: float, radius_km: float) -> Column:
    """Degree box around a circle, for pushdown; wraps at the antimeridian and opens up at the poles."""
    d = math.degrees(radius_km * geo.ELLIPSOID_MARGIN / geo.EARTH_RADIUS_KM)
    south, north = lat - d, lat + d
    box = F.col("latitude").between(south, north)
    if south <= -90 or north >= 90 or d >= 90:
        return box
    w = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat)))))
    west, east = lon - w, lon + w
    if w >= 180:
        return box
    if west < -180:
        return box & ((F.col("longitude") >= west + 360) | (F.col("longitude") <= east))
    if east > 180:
        return box & ((F.col("longitude") >= west) | (F.col("longitude") <= east - 360))
    return box & F.col("longitude").between(west, east)


def nearby(
    points: DataFrame, lat: float, lon: float, radius_km: float, limit: int | None = None, location_type: str | None = None, method: str = "geodesic"
) -> DataFrame:
    """Live points within a radius of one centre, nearest first."""
    if not 0 < radius_km <= MAX_RADIUS_KM:
        raise ValueError("radius must lie in (0, 10000] km")
    rows = points.filter(near_box(lat, lon, radius_km))
    if "is_deleted" in points.columns:
        rows = rows.filter(~F.col("is_deleted"))
    if location_type is not None:
        rows = rows.filter(F.col("location_type") == location_type)
    km = _distance(method)(F.col("latitude"), F.col("longitude"), F.lit(float(lat)), F.lit(float(lon)))
    rows = rows.withColumn("__km", km).filter(F.col("__km") <= float(radius_km)).withColumn("distance_km", F.round("__km", 2))
    if limit is not None:
        rows = rows.orderBy("__km", "id").limit(limit)
    return rows.drop("__km")


def _bits_for(size: float) -> int:
    """Finest grid whose cells are not smaller than ``size`` on the unit sphere."""
    return max(0, min(geo.CELL_BITS - 1, math.floor(math.log2(2.0 / size)))) if size > 0 else geo.CELL_BITS - 1


def _touched(centers: DataFrame, reach: float, bits: int) -> DataFrame:
    """Centres with their unit vectors ``qx, qy, qz``, one row for every ``cell`` that a ball of radius ``reach`` can touch."""
    step = 2.0 / (1 << bits)
    top = (1 << bits) - 1

    def slices(v: str) -> Column:
        lo = F.greatest(F.lit(0), F.floor((F.col(v) - reach + 1) / step)).cast("bigint")
        hi = F.least(F.lit(top), F.floor((F.col(v) + reach + 1) / step)).cast("bigint")
        return F.sequence(lo, hi)

    c = centers.select(F.col("center_id"), F.col("latitude").alias("center_lat"), F.col("longitude").alias("center_lon"))
    c = c.filter("center_lat IS NOT NULL AND center_lon IS NOT NULL")
    c = c.withColumns({f"q{v}": e for v, e in geo.unit_vector(F.col("center_lat"), F.col("center_lon")).items()})
    c = c.withColumn("__ix", F.explode(slices("qx"))).withColumn("__iy", F.explode(slices("qy"))).withColumn("__iz", F.explode(slices("qz")))

    def gap(v: str, i: str) -> Column:
        lo = F.col(i) * step - 1
        return F.greatest(F.lit(0.0), lo - F.col(v), F.col(v) - (lo + step))

    d2 = sum((gap(f"q{v}", f"__i{v}") * gap(f"q{v}", f"__i{v}") for v in "xyz"), F.lit(0.0))
    return c.filter(d2 <= reach * reach * (1 + 1e-9)).select(*CENTER, geo.pack(F.col("__ix"), F.col("__iy"), F.col("__iz")).alias("cell"))


def within_radius(points: DataFrame, centers: DataFrame, radius_km: float, method: str = "haversine") -> DataFrame:
    """All (center, point) pairs within a radius: grid equi join on the unit sphere, then the exact test.

    A centre visits the cells its ball can touch; a point has one cell, so no pair shows up twice. Hot
    cells are split by ``salted_join``. For the k nearest only, ``nearest`` avoids listing the pairs.
    """
    reach = geo.chord(radius_km * geo.ELLIPSOID_MARGIN)
    bits = _bits_for(reach)
    c = _touched(centers, reach, bits).select("center_id", "center_lat", "center_lon", F.col("cell").alias("__cell"))
    p = points.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    p = p.withColumns(geo.unit_vector(F.col("latitude"), F.col("longitude")))
    p = p.withColumn("__cell", geo.pack(*[geo.axis_index(F.col(v), bits) for v in "xyz"])).drop("x", "y", "z")
    km = _distance(method)(F.col("latitude"), F.col("longitude"), F.col("center_lat"), F.col("center_lon"))
    joined = salted_join(p, c, ["__cell"], "id")
    return joined.withColumn("distance_km", km).filter(F.col("distance_km") <= radius_km).drop("__cell", "center_lat", "center_lon")


LEVEL_STEP = 2
START_BITS = 2
FINEST = 20  # slices per axis as a power of two: about 12 m
LEAF_SITES = 64


def nearest(
    queries: DataFrame, points: DataFrame, k: int = 1, radius_km: float | None = None, leaf_sites: int = LEAF_SITES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact k nearest points per query (great circle), for any distribution of either side.

    Points become sites (distinct positions with their k smallest ids), sites an occupancy grid at growing
    fineness. Every query walks down the grid: per level it keeps the cells that can still hold one of its
    k nearest, judged by the distance to each cell's tight box and the number of sites inside. So a query
    meets a handful of cells per level, and sites only in the last one; a dense spot is never listed whole.

    ``queries`` has ``query_id, latitude, longitude``; ``points`` has ``id, latitude, longitude``. The result
    is ``query_id, id, rank, distance_km``.
    """
    sites = points.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("id", "latitude", "longitude")
    if k == 1:
        sites = sites.groupBy("latitude", "longitude").agg(F.min("id").alias("id"))
    else:
        w = Window.partitionBy("latitude", "longitude").orderBy("id")
        sites = sites.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")
    sites = sites.withColumns(geo.unit_vector(F.col("latitude"), F.col("longitude")))
    sites = cut_lineage(sites.withColumns({f"i{v}": geo.axis_index(F.col(v), FINEST) for v in "xyz"}))
    sides = [f"{e}_{v}" for e in ("lo", "hi") for v in "xyz"]
    boxes = [F.min(v).alias(f"lo_{v}") for v in "xyz"] + [F.max(v).alias(f"hi_{v}") for v in "xyz"]
    merged = [F.min(f"lo_{v}").alias(f"lo_{v}") for v in "xyz"] + [F.max(f"hi_{v}").alias(f"hi_{v}") for v in "xyz"]
    # the finest occupancy is written once, every level is grouped from it
    finest = cut_lineage(sites.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), *boxes))
    last = _leaf_bits(finest, leaf_sites)
    levels = list(range(START_BITS, last + 1, LEVEL_STEP))

    def occupancy(bits: int) -> DataFrame:
        return finest.groupBy(_cell(bits).alias("cell")).agg(F.min(_cell(max(START_BITS, bits - LEVEL_STEP))).alias("parent"), F.sum("n").alias("n"), *merged)

    reach = 2.0 if radius_km is None else geo.chord(radius_km) * (1 + 1e-9)
    # queries at the same place walk together and part again at the end
    asked = queries.select("query_id", F.col("latitude").alias("q_lat"), F.col("longitude").alias("q_lon"))
    q = asked.filter("q_lat IS NOT NULL AND q_lon IS NOT NULL").groupBy("q_lat", "q_lon").agg(F.min("query_id").alias("query_id"))
    q = q.withColumns({f"q{v}": e for v, e in geo.unit_vector(F.col("q_lat"), F.col("q_lon")).items()})
    q_cols = ["query_id", "q_lat", "q_lon", "qx", "qy", "qz"]
    # the first level has at most 64 cells, so it travels as one literal
    first = [r.asDict() for r in occupancy(START_BITS).drop("parent").collect()]
    shape = ",".join(["cell:bigint", "n:bigint", *[f"{c}:double" for c in sides]])
    start = F.from_json(F.lit(json.dumps(first)), f"array<struct<{shape}>>")
    if not first:
        return q.select("query_id", F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance_km")).limit(0)
    cand = _keep(q.select(*q_cols, F.lit(2.0).alias("__bound"), F.inline(start)), q_cols, k, reach)
    for bits in levels[1:]:
        children = occupancy(bits).withColumnsRenamed({"cell": "child", "parent": "cell"})
        cand = _keep(cand.join(children, "cell").drop("cell").withColumnRenamed("child", "cell"), q_cols, k, reach)
    # straight-line distance ranks like surface distance and is cheaper; the latter is worked out for the winners
    gaps = [(F.col(v) - F.col(f"q{v}")) * (F.col(v) - F.col(f"q{v}")) for v in "xyz"]
    spots = sites.select(_cell(last).alias("cell"), "id", "latitude", "longitude", *"xyz")
    pairs = salted_join(spots, cand.select(*q_cols, "cell"), ["cell"], "id", hot_rows)  # each part gives its own k best before the shuffle
    # positions less than a hundredth of a millimetre apart count as one; the smaller id wins
    pairs = pairs.withColumn("__gap", F.round(F.sqrt(gaps[0] + gaps[1] + gaps[2]), 12))
    if k == 1:
        best = pairs.groupBy("q_lat", "q_lon").agg(F.min(F.struct("__gap", "id", "latitude", "longitude")).alias("best"))
        won = best.select("q_lat", "q_lon", "best.id", F.lit(1).alias("rank"), "best.latitude", "best.longitude")
    else:
        w = Window.partitionBy("q_lat", "q_lon").orderBy("__gap", "id")
        won = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    won = won.withColumn("distance_km", geo.haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("latitude"), F.col("longitude")))
    if radius_km is not None:
        won = won.filter(F.col("distance_km") <= radius_km)
    return asked.join(won.select("q_lat", "q_lon", "id", "rank", "distance_km"), ["q_lat", "q_lon"]).select("query_id", "id", "rank", "distance_km")


def _cell(bits: int) -> Column:
    """Packed grid cell of a finest-level position."""
    return geo.pack(*[F.shiftright(f"i{v}", FINEST - bits) for v in "xyz"])


def _leaf_bits(finest: DataFrame, leaf_sites: int) -> int:
    """The coarsest grid level at which no cell holds more than ``leaf_sites`` sites."""
    options = list(range(START_BITS, FINEST + 1, LEVEL_STEP))
    per_level = F.array(*[F.struct(F.lit(bits).alias("bits"), _cell(bits).alias("cell")) for bits in options])
    cells = finest.select("n", F.inline(per_level)).groupBy("bits", "cell").agg(F.sum("n").alias("n"))
    fits = cells.groupBy("bits").agg(F.max("n").alias("most")).filter(F.col("most") <= leaf_sites)
    return fits.agg(F.coalesce(F.min("bits"), F.lit(FINEST))).first()[0]


def _bounds(box: Callable[[str], Column]) -> tuple[Column, Column]:
    """Least and greatest straight-line distance from the query to a box."""
    lows, highs = [], []
    for v in "xyz":
        below, above = box(f"lo_{v}") - F.col(f"q{v}"), F.col(f"q{v}") - box(f"hi_{v}")
        lows.append(F.greatest(F.lit(0.0), below, above))
        highs.append(F.greatest(F.abs(below), F.abs(above)))
    return tuple(F.sqrt(x * x + y * y + z * z) for x, y, z in (lows, highs))


# covers rounding between chord and great-circle arithmetic
SLACK = 1e-9


def _keep(cand: DataFrame, q_cols: list[str], k: int, reach: float) -> DataFrame:
    """Cells that may still hold one of the k nearest: lower bound not above the k-th upper bound."""
    lb, ub = _bounds(F.col)
    rows = cand.select(*q_cols, "cell", "n", "__bound", lb.alias("__lb"), ub.alias("__ub"))
    rows = rows.filter(F.col("__lb") <= F.least(F.col("__bound"), F.lit(reach)) + SLACK)
    per_query = Window.partitionBy("query_id")
    if k == 1:
        bound = F.min("__ub").over(per_query)
    else:
        seen = F.sum("n").over(per_query.orderBy("__ub", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("__seen", seen)
        bound = F.min(F.when(F.col("__seen") >= k, F.col("__ub"))).over(per_query)
    rows = rows.withColumn("__bound", F.least("__bound", bound))
    return rows.filter(F.col("__lb") <= F.col("__bound") + SLACK).select(*q_cols, "__bound", "cell")


AREA = 4096  # distinct centres that meet points together
BAG = 256  # distinct points that are met together
TASK_BAGS = 4096
Z_STEPS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _in_z_order(spots: DataFrame) -> DataFrame:
    """Distinct positions dealt by range and sorted along the finest grid, neighbours in space mostly side by side."""

    def apart(v: str) -> Column:
        x = geo.axis_index(F.col(v), FINEST)
        for by, mask in Z_STEPS:
            x = F.transform(F.array(x), lambda y: F.shiftleft(y, by).bitwiseOR(y).bitwiseAND(F.lit(mask)))[0]
        return x

    units = spots.withColumns(geo.unit_vector(F.col("latitude"), F.col("longitude")))
    z = F.shiftleft(apart("x"), 2).bitwiseOR(F.shiftleft(apart("y"), 1)).bitwiseOR(apart("z"))
    order = ["__z", "latitude", "longitude"]
    return units.withColumn("__z", z).select("__z", *spots.columns).repartitionByRange(*order).sortWithinPartitions(*order).drop("__z")


def _spots(rows: DataFrame, *totals: Column) -> DataFrame:
    """Distinct positions of the rows that have one, as doubles."""
    placed = rows.withColumns({v: F.col(v).cast("double") for v in ("latitude", "longitude")})
    return placed.filter((F.abs("latitude") < math.inf) & (F.abs("longitude") < math.inf)).groupBy("latitude", "longitude").agg(*totals)


def _coded(spots: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``first`` as a long in the order of the ids, ``NO_ID`` for null, and the ids by that number where they are no whole numbers."""
    code, ids = F.col("first").cast("long"), None
    if not isinstance(spots.schema["first"].dataType, IntegralType):
        spots = cut_lineage(spots.orderBy("first").withColumn("code", F.monotonically_increasing_id()))
        code, ids = F.when(F.col("first").isNotNull(), F.col("code")), spots.select("code", F.col("first").alias("first_id"))
    return spots.select("latitude", "longitude", "n", F.coalesce(code, F.lit(balls.NO_ID)).alias("first")), ids


def count_within(
    points: DataFrame, centers: DataFrame, radius_km: float, method: str = "haversine", leaf_sites: int = BAG, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``center_id, hits, first_id, farthest_km`` of every centre with a point within a radius, without listing the pairs.

    Distinct points are cut into bags of at most ``leaf_sites`` neighbours, distinct centres into areas of at most ``AREA``, so
    no spot is too dense for a task. Bags wholly inside the ball of every centre of an area answer by their stored count
    and smallest id; they stay in play for the farthest point alone, while their box can reach beyond what another bag is sure to hold.
    A task holds one area and meets its bags one by one, far ones first: blocks of 64 centres count a bag that is wholly inside by
    its total, and centres measure, in arrays, only what their border cuts or what can be farther than what they have. Straight
    lines decide all but pairs so near to the radius that rounding, or the ellipsoid, matters; these are listed for the exact distance.

    Rows shuffled are bags, areas and undecided pairs. Rows of one ``center_id`` are counted together; points and centres without
    a position take no part.
    """
    margin = 1.0 if method == "haversine" else geo.ELLIPSOID_MARGIN
    outer, inner = geo.chord(radius_km * margin) + SLACK, geo.chord(radius_km / margin) - SLACK
    bits = min(FINEST, _bits_for(outer))
    box = ", ".join(f"{s} double" for s in balls.SIDES)
    shape = f"bag long, {box}, cells array<long>, n long, first long, lat array<double>, lon array<double>, ns array<long>, firsts array<long>"
    sites, ids = _coded(_spots(points, F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
    bags = cut_lineage(_in_z_order(sites).mapInPandas(balls.bags(leaf_sites, bits, None), shape))
    asked = _spots(centers, F.lit(0).cast("long").alias("n")).withColumn("first", F.lit(balls.NO_ID))
    areas = cut_lineage(_in_z_order(asked).mapInPandas(balls.bags(AREA, bits, outer), shape).withColumnsRenamed({"bag": "area", **{s: f"area_{s}" for s in balls.SIDES}}))

    def surface(chord: Column) -> Column:
        return F.lit(2 * geo.EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), chord / 2))

    sides = [f"area_{s}" for s in balls.SIDES]
    met = areas.select("area", *sides, F.explode("cells").alias("cell")).join(bags.select("bag", *balls.SIDES, "n", "first", F.explode("cells").alias("cell")), "cell")
    near, far = _box_bounds()
    judged = met.drop("cell").distinct().select("area", "bag", "n", "first", near.alias("near"), far.alias("far")).filter(F.col("near") <= outer)
    judged = cut_lineage(judged.withColumn("counted", F.col("far") <= inner))
    whole = judged.filter("counted").groupBy("area").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max(surface(F.col("near")) / margin).alias("sure"))
    in_play = ~F.col("counted") | (surface(F.col("far")) * margin + SLACK * geo.EARTH_RADIUS_KM >= F.col("sure"))
    rest = cut_lineage(judged.drop("n", "first").join(whole.select("area", "sure"), "area", "left").filter(in_play).select("area", "bag", "far", "counted"))
    parts = rest.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / TASK_BAGS).cast("int").alias("parts"))
    calls = salted_join(rest.join(parts, "area"), bags.select("bag", "lat", "lon", "ns", "firsts"), ["bag"], "area", hot_rows)
    part = F.pmod(F.xxhash64("bag"), F.col("parts")).cast("int").alias("part")
    calls = calls.select("area", part, F.lit(1).alias("side"), "far", "counted", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("first"), "lat", "lon", "ns", "firsts")
    hosts = areas.select("area", "lat", "lon").join(parts, "area").join(whole, "area", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def own(c: str, none: int) -> Column:
        """Totals of the whole area go to its first part."""
        return F.coalesce(F.when(F.col("part") == 0, F.col(c)), F.lit(none)).alias(c)

    nothing = F.array().cast("array<long>")
    hosts = hosts.select(
        "area", "part", F.lit(0).alias("side"), F.lit(0.0).alias("far"), F.lit(False).alias("counted"), own("n", 0), own("first", balls.NO_ID), "lat", "lon", nothing.alias("ns"), nothing.alias("firsts")
    )
    rows = hosts.unionByName(calls).repartition("area", "part").sortWithinPartitions("area", "part", "side", F.col("far").desc())
    found = rows.mapInPandas(balls.meetings(outer, inner, margin), balls.FOUND)
    km = F.when(~F.isnan("lat"), _distance(method)(F.col("lat"), F.col("lon"), F.col("q_lat"), F.col("q_lon")))
    found = found.withColumn("km", km).filter((F.col("kind") != balls.OPEN) | (F.col("km") <= radius_km))
    first = F.min(F.when(F.col("first") < balls.NO_ID, F.col("first"))).alias("first")
    per_spot = found.groupBy("q_lat", "q_lon").agg(F.sum("n").alias("hits"), first, F.max("km").alias("km")).filter("hits > 0")
    named = centers.select("center_id", F.col("latitude").cast("double").alias("q_lat"), F.col("longitude").cast("double").alias("q_lon"))
    out = named.join(per_spot, ["q_lat", "q_lon"]).groupBy("center_id").agg(F.sum("hits").alias("hits"), F.min("first").alias("first"), F.max("km").alias("farthest_km"))
    if ids is None:
        return out.select("center_id", "hits", F.col("first").cast(points.schema["id"].dataType).alias("first_id"), "farthest_km")
    return out.join(ids.withColumnRenamed("code", "first"), "first", "left").select("center_id", "hits", "first_id", "farthest_km")


def _box_bounds() -> tuple[Column, Column]:
    """Least and greatest straight-line distance between a bag's box and its area's."""
    lows, highs = [], []
    for v in "xyz":
        below, above = F.col(f"lo_{v}") - F.col(f"area_hi_{v}"), F.col(f"area_lo_{v}") - F.col(f"hi_{v}")
        lows.append(F.greatest(F.lit(0.0), below, above))
        highs.append(F.greatest(F.col(f"hi_{v}") - F.col(f"area_lo_{v}"), F.col(f"area_hi_{v}") - F.col(f"lo_{v}")))
    return tuple(F.sqrt(x * x + y * y + z * z) for x, y, z in (lows, highs))


# --- polygons and boxes ---------------------------------------------------------------------------


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint"))


def contains_join(points: DataFrame, polygons: DataFrame, cell_deg: float = 5.0) -> DataFrame:
    """(point, polygon) pairs by ray casting; ``polygons`` has ``polygon_id, ring`` of ``struct(lon, lat)``."""
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    poly = polygons.select(
        "polygon_id",
        "ring",
        F.array_min(lats).alias("south"),
        F.array_max(lats).alias("north"),
        F.array_min(lons).alias("west"),
        F.array_max(lons).alias("east"),
    )
    poly = poly.withColumn("__ci", F.explode(_cells(F.col("south"), F.col("north"), cell_deg))).withColumn(
        "__cj", F.explode(_cells(F.col("west"), F.col("east"), cell_deg))
    )
    pts = points.withColumns(
        {"__ci": F.floor(F.col("latitude") / cell_deg).cast("bigint"), "__cj": F.floor(F.col("longitude") / cell_deg).cast("bigint")}
    )
    in_box = F.col("latitude").between(F.col("south"), F.col("north")) & F.col("longitude").between(F.col("west"), F.col("east"))
    pairs = salted_join(pts, poly, ["__ci", "__cj"], "id").filter(in_box)
    return pairs.filter(geo.in_ring(F.col("latitude"), F.col("longitude"), F.col("ring"))).drop(
        "__ci", "__cj", "ring", "south", "north", "west", "east"
    )


def overlap_join(left: DataFrame, right: DataFrame, cell_deg: float = 5.0) -> DataFrame:
    """(left_id, right_id) of overlapping boxes ``id, south, west, north, east``.

    Both sides visit their cells; a pair is taken only in the cell of its common south-west corner, so it
    appears once without a distinct.
    """

    def placed(df: DataFrame, side: str) -> DataFrame:
        cols = [F.col(c).alias(f"{side}_{c}") for c in ("id", "south", "west", "north", "east")]
        out = df.select(*cols)
        out = out.withColumn("__ci", F.explode(_cells(F.col(f"{side}_south"), F.col(f"{side}_north"), cell_deg)))
        return out.withColumn("__cj", F.explode(_cells(F.col(f"{side}_west"), F.col(f"{side}_east"), cell_deg)))

    pairs = salted_join(placed(left, "left"), placed(right, "right"), ["__ci", "__cj"], "left_id")
    overlap = (
        (F.col("left_south") <= F.col("right_north"))
        & (F.col("right_south") <= F.col("left_north"))
        & (F.col("left_west") <= F.col("right_east"))
        & (F.col("right_west") <= F.col("left_east"))
    )
    corner = (F.floor(F.greatest("left_south", "right_south") / cell_deg).cast("bigint") == F.col("__ci")) & (
        F.floor(F.greatest("left_west", "right_west") / cell_deg).cast("bigint") == F.col("__cj")
    )
    return pairs.filter(overlap & corner).select("left_id", "right_id")


# --- gazetteer, routes, summaries -----------------------------------------------------------------


def normal_address(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def geocode(addresses: DataFrame, gazetteer: DataFrame, address: str = "address") -> DataFrame:
    """Coordinates by normalised address text; unknown addresses stay with null coordinates."""
    places = gazetteer.groupBy(normal_address(F.col(address)).alias("__key")).agg(
        F.min(F.struct("place_id", "latitude", "longitude")).alias("p")
    )
    hit = addresses.withColumn("__key", normal_address(F.col(address))).join(places, "__key", "left")
    return hit.select(*addresses.columns, "p.place_id", "p.latitude", "p.longitude")


def route_legs(stops: DataFrame, route: str = "route_id", seq: str = "seq") -> DataFrame:
    """Distance from the previous stop and running total per route, in the given order."""
    legs = neighbour(cut_lineage(stops), [route], [seq], {"latitude": "prev_lat", "longitude": "prev_lon"})
    km = F.coalesce(geo.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("latitude"), F.col("longitude")), F.lit(0.0))
    return running_sum(cut_lineage(legs.withColumn("leg_km", km).drop("prev_lat", "prev_lon")), [route], [seq], "leg_km", "total_km")


def centroid(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean position of the points that have one; 0.0 is a position like any other."""
    known = points.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    return known.groupBy(*(keys or [])).agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count(F.lit(1)).alias("points"))


def density(points: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Points per grid cell with the cell's south-west corner."""
    return points.groupBy(
        (F.floor(F.col("latitude") / cell_deg) * cell_deg).alias("south"), (F.floor(F.col("longitude") / cell_deg) * cell_deg).alias("west")
    ).agg(F.count(F.lit(1)).alias("points"))
