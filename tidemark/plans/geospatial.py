"""Radius, nearest, polygon, route and cluster queries."""

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import cluster, spatial
from tidemark.plans.registry import query


def hav(a1, o1, a2, o2):
    """The great-circle formula as SQL text."""
    return (
        f"CASE WHEN ({a1}) IS NOT NULL AND ({o1}) IS NOT NULL AND ({a2}) IS NOT NULL AND ({o2}) IS NOT NULL THEN 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2}))"
        f" * pow(sin((radians({o2}) - radians({o1})) / 2), 2)))) END"
    )


@query(
    "nearby_radius",
    "J4 J5 P9 T4",
    f"""SELECT id, name, location_type, round({hav('latitude', 'longitude', 19.07, 72.88)}, 2) AS distance_km FROM locations
    WHERE NOT is_deleted AND {hav('latitude', 'longitude', 19.07, 72.88)} <= 3000 ORDER BY {hav('latitude', 'longitude', 19.07, 72.88)}, id LIMIT 40""",
    ("locations",),
)
def nearby_radius(t):
    """Forty nearest live locations within 3000 km of one centre."""
    out = spatial.nearby(t.locations, 19.07, 72.88, 3000.0, limit=40, method="haversine")
    return out.select("id", "name", "location_type", "distance_km")


def geodesic_sql(src: str, steps: int = 25) -> str:
    """Ellipsoid distance by iterating one longitude difference per row; ``src`` has id, a1, o1, a2, o2."""
    f, b = geo.WGS84_F, geo.WGS84_B
    k = (b * 0 + (geo.WGS84_A**2 - b**2) / b**2)
    return f"""WITH RECURSIVE base AS (SELECT id, a1, o1, a2, o2, atan((1 - {f!r}) * tan(radians(a1))) AS u1, atan((1 - {f!r}) * tan(radians(a2))) AS u2, radians(o2 - o1) AS dl FROM ({src})),
    it AS (SELECT id, 0 AS k, dl AS lam, CAST(1 AS DOUBLE) AS move FROM base
      UNION ALL SELECT id, k + 1, nl, abs(nl - lam) FROM (
        SELECT id, k, lam, dl + (1 - c) * {f!r} * sa * (sg + c * ss * (md + c * cs * (2 * md * md - 1))) AS nl FROM (
          SELECT *, {f!r} / 16 * c2 * (4 + {f!r} * (4 - 3 * c2)) AS c FROM (
            SELECT *, CASE WHEN c2 > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / c2 ELSE 0 END AS md, atan2(ss, cs) AS sg FROM (
              SELECT *, 1 - sa * sa AS c2 FROM (
                SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM (
                  SELECT it.id, it.k, it.lam, dl, u1, u2, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
                    sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it JOIN base ON it.id = base.id WHERE it.k < {steps}))))))),
    fin AS (SELECT *, 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us))) AS ba, us / 1024 * (256 + us * (-128 + us * (74 - 47 * us))) AS bb FROM (
      SELECT *, c2 * {k!r} AS us, CASE WHEN c2 > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / c2 ELSE 0 END AS md, atan2(ss, cs) AS sg FROM (
        SELECT *, 1 - pow(CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END, 2) AS c2 FROM (
          SELECT it.id, it.lam, it.move, a1, o1, a2, o2, u1, u2, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
            sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it JOIN base ON it.id = base.id WHERE it.k = {steps})))),
    dist AS (SELECT id, CASE WHEN a1 = a2 AND o1 = o2 THEN 0 WHEN move < 1e-9 THEN
      {b!r} * ba * (sg - bb * ss * (md + bb / 4 * (cs * (2 * md * md - 1) - bb / 6 * md * (4 * ss * ss - 3) * (4 * md * md - 3))))
      ELSE {hav('a1', 'o1', 'a2', 'o2')} END AS km FROM fin)"""


@query(
    "geodesic_distance",
    "F1 F29",
    geodesic_sql("SELECT id, latitude AS a1, longitude AS o1, CAST(28.6139 AS DOUBLE) AS a2, CAST(77.209 AS DOUBLE) AS o2 FROM locations")
    + " SELECT id, round(km, 2) AS km, round(km * 0.621371, 2) AS miles, round(km * 1000, 2) AS meters FROM dist",
    ("locations",),
)
def geodesic_distance(t):
    """Ellipsoid distance of every location to one place in three units."""
    km = geo.geodesic_km(F.col("latitude"), F.col("longitude"), F.lit(28.6139), F.lit(77.209))
    df = t.locations.select("id", km.alias("d"))
    return df.select("id", *[geo.convert_km(F.col("d"), u).alias(u) for u in ("km", "miles", "meters")])


@query(
    "nearby_geodesic",
    "J4 J5",
    geodesic_sql("SELECT id, latitude AS a1, longitude AS o1, CAST(-33.86 AS DOUBLE) AS a2, CAST(151.21 AS DOUBLE) AS o2 FROM locations WHERE NOT is_deleted AND location_type = 'city'")
    + " SELECT id, round(km, 2) AS distance_km FROM dist WHERE km <= 5000",
    ("locations",),
)
def nearby_geodesic(t):
    """Cities within 5000 ellipsoid kilometres, the circle crossing the antimeridian."""
    return spatial.nearby(t.locations, -33.86, 151.21, 5000.0, location_type="city").select("id", "distance_km")


_PARTS = """SELECT p_partkey AS pid, CAST((p_partkey * 104729) % 18000 AS DOUBLE) / 100 - 90 AS la, CAST((p_partkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lo FROM part"""


def _part_points(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("pid"),
        (((k * 104729) % 18000).cast("double") / 100 - 90).alias("latitude"),
        (((k * 7919) % 36000).cast("double") / 100 - 180).alias("longitude"),
    )


@query(
    "nearby_join",
    "J4",
    f"""WITH c AS ({_PARTS}) SELECT pid AS center_id, count(*) AS hits, min(id) AS first_id, round(max({hav('latitude', 'longitude', 'la', 'lo')}), 3) AS farthest_km
    FROM c, locations WHERE NOT is_deleted AND {hav('latitude', 'longitude', 'la', 'lo')} <= 500 GROUP BY pid""",
    ("locations",),
)
def nearby_join(t):
    """Live locations within 500 km of every centre of a table: count, first id, farthest."""
    centers = _part_points(t).withColumnRenamed("pid", "center_id")
    found = spatial.count_within(t.locations.filter("NOT is_deleted").select("id", "latitude", "longitude"), centers, 500.0)
    return found.withColumn("farthest_km", F.round("farthest_km", 3))


@query(
    "nearest_place",
    "J8",
    f"""WITH q AS ({_PARTS}), d AS (SELECT pid, id, name, {hav('latitude', 'longitude', 'la', 'lo')} AS km FROM q, locations WHERE NOT is_deleted),
    r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(km, 6), id) AS rn FROM d)
    SELECT pid AS query_id, id, name, round(km, 3) AS distance_km FROM r WHERE rn = 1""",
    ("locations",),
)
def nearest_place(t):
    """Nearest live location for every point of a table."""
    places = t.locations.filter("NOT is_deleted")
    best = spatial.nearest(_part_points(t).withColumnRenamed("pid", "query_id"), places)
    return best.join(places.select("id", "name"), "id").select("query_id", "id", "name", F.round("distance_km", 3).alias("distance_km"))


@query(
    "nearby_topk",
    "J4 T4",
    f"""WITH q AS ({_PARTS}), d AS (SELECT pid, id, {hav('latitude', 'longitude', 'la', 'lo')} AS km FROM q, locations WHERE NOT is_deleted),
    r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(km, 6), id) AS rn FROM d WHERE km <= 1500)
    SELECT pid AS query_id, id, CAST(rn AS INTEGER) AS rank, round(km, 3) AS distance_km FROM r WHERE rn <= 5""",
    ("locations",),
)
def nearby_topk(t):
    """Five nearest live locations within 1500 km for every point of a table."""
    out = spatial.nearest(_part_points(t).withColumnRenamed("pid", "query_id"), t.locations.filter("NOT is_deleted"), k=5, radius_km=1500.0)
    return out.withColumn("distance_km", F.round("distance_km", 3))


_POLY = """SELECT n_nationkey AS polygon_id, CAST((n_nationkey * 29) % 300 - 150 AS DOUBLE) AS x, CAST((n_nationkey * 13) % 120 - 60 AS DOUBLE) AS y FROM nation"""


def _polygons(t):
    x, y = F.col("x"), F.col("y")

    def p(dx, dy):
        return F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))

    k = F.col("n_nationkey")
    base = t.nation.select(k.alias("polygon_id"), ((k * 29) % 300 - 150).cast("double").alias("x"), ((k * 13) % 120 - 60).cast("double").alias("y"))
    return base.select("polygon_id", F.array(p(-15, -10), p(15, -10), p(15, 10), p(0, 0), p(-15, 10)).alias("ring"))


@query(
    "polygon_contains",
    "J6",
    f"""WITH p AS ({_POLY}), e AS (
      SELECT polygon_id, x - 15 AS ax, y - 10 AS ay, x + 15 AS bx, y - 10 AS by_ FROM p UNION ALL SELECT polygon_id, x + 15, y - 10, x + 15, y + 10 FROM p
      UNION ALL SELECT polygon_id, x + 15, y + 10, x, y FROM p UNION ALL SELECT polygon_id, x, y, x - 15, y + 10 FROM p
      UNION ALL SELECT polygon_id, x - 15, y + 10, x - 15, y - 10 FROM p)
    SELECT id, polygon_id FROM locations, e WHERE (ay > latitude) <> (by_ > latitude) AND longitude < ax + (latitude - ay) * (bx - ax) / (by_ - ay)
    GROUP BY id, polygon_id HAVING count(*) % 2 = 1""",
    ("locations",),
)
def polygon_contains(t):
    """Locations inside concave region polygons."""
    return spatial.contains_join(t.locations.select("id", "latitude", "longitude"), _polygons(t)).select("id", "polygon_id")


def _boxes(df, key, m1, m2, w):
    k = F.col(key)
    south = ((k * m1) % 1700).cast("double") / 10 - 85
    west = ((k * m2) % 3500).cast("double") / 10 - 175
    return df.select(k.alias("id"), south.alias("south"), west.alias("west"), (south + w).alias("north"), (west + w * 2).alias("east"))


def _boxes_sql(table, key, m1, m2, w):
    return f"""SELECT {key} AS id, CAST(({key} * {m1}) % 1700 AS DOUBLE) / 10 - 85 AS s, CAST(({key} * {m2}) % 3500 AS DOUBLE) / 10 - 175 AS w,
      CAST(({key} * {m1}) % 1700 AS DOUBLE) / 10 - 85 + {w} AS n, CAST(({key} * {m2}) % 3500 AS DOUBLE) / 10 - 175 + {w} * 2 AS e FROM {table}"""


@query(
    "edges_overlap",
    "J11",
    f"""WITH a AS ({_boxes_sql('customer', 'c_custkey', 7919, 104729, 1.5)}), b AS ({_boxes_sql('supplier', 's_suppkey', 3571, 15485863, 3.0)})
    SELECT a.id AS left_id, b.id AS right_id FROM a, b WHERE a.s <= b.n AND b.s <= a.n AND a.w <= b.e AND b.w <= a.e""",
)
def edges_overlap(t):
    """SPATIALLY_OVERLAPS edges between two tables of boxes."""
    left = _boxes(t.customer, "c_custkey", 7919, 104729, 1.5)
    return spatial.overlap_join(left, _boxes(t.supplier, "s_suppkey", 3571, 15485863, 3.0))


@query(
    "buffer_count",
    "F30 P9",
    f"""SELECT count(*) AS inside FROM locations WHERE {hav('latitude', 'longitude', 12.97, 77.59)} * 1000 <= 900000""",
    ("locations",),
)
def buffer_count(t):
    """Points inside a 900 km buffer around a point."""
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(12.97), F.lit(77.59))
    rows = t.locations.filter(spatial.near_box(12.97, 77.59, 900.0))
    return rows.agg(F.count_if(km * 1000 <= 900000).alias("inside"))


@query(
    "geocode",
    "J7",
    """WITH g AS (SELECT min(s_suppkey) AS place_id, trim(regexp_replace(lower(s_name || ', Nation ' || s_nationkey), '[^a-z0-9]+', ' ', 'g')) AS k FROM supplier GROUP BY 2),
    a AS (SELECT o_orderkey, trim(regexp_replace(lower('  SUPPLIER-' || lpad(CAST(o_custkey % 150 AS VARCHAR), 9, '0') || ' / nation_' || (o_custkey % 25)), '[^a-z0-9]+', ' ', 'g')) AS k FROM orders)
    SELECT o_orderkey, place_id, CAST(place_id AS DOUBLE) / 10 AS latitude FROM a LEFT JOIN g USING (k)""",
)
def geocode(t):
    """Free-form addresses matched to a gazetteer by normalised text."""
    gaz = t.supplier.select(
        F.col("s_suppkey").alias("place_id"),
        F.concat(F.col("s_name"), F.lit(", Nation "), F.col("s_nationkey").cast("string")).alias("address"),
        (F.col("s_suppkey").cast("double") / 10).alias("latitude"),
        (F.col("s_suppkey").cast("double") / 5).alias("longitude"),
    )
    text = F.concat(
        F.lit("  SUPPLIER-"), F.lpad((F.col("o_custkey") % 150).cast("string"), 9, "0"), F.lit(" / nation_"), (F.col("o_custkey") % 25).cast("string")
    )
    return spatial.geocode(t.orders.select("o_orderkey", text.alias("address")), gaz).select("o_orderkey", "place_id", "latitude")


_STOPS = """SELECT user_id AS route_id, event_id AS seq, CAST((event_id * 37) % 1700 AS DOUBLE) / 10 - 85 AS la, CAST((event_id * 101) % 3600 AS DOUBLE) / 10 - 180 AS lo FROM events"""


@query(
    "route_legs",
    "W7",
    f"""WITH s AS ({_STOPS}), l AS (SELECT *, lag(la) OVER w AS pa, lag(lo) OVER w AS po FROM s WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
    k AS (SELECT route_id, seq, coalesce({hav('pa', 'po', 'la', 'lo')}, 0) AS km FROM l)
    SELECT route_id, seq, round(km, 3) AS leg_km, round(sum(km) OVER (PARTITION BY route_id ORDER BY seq), 3) AS total_km FROM k""",
)
def route_legs(t):
    """Leg and running distance of every stop of every route."""
    k = F.col("event_id")
    stops = t.events.select(
        F.col("user_id").alias("route_id"),
        k.alias("seq"),
        (((k * 37) % 1700).cast("double") / 10 - 85).alias("latitude"),
        (((k * 101) % 3600).cast("double") / 10 - 180).alias("longitude"),
    )
    out = spatial.route_legs(stops)
    return out.select("route_id", "seq", F.round("leg_km", 3).alias("leg_km"), F.round("total_km", 3).alias("total_km"))


@query(
    "centroid",
    "A27",
    "SELECT location_type, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, count(*) AS points FROM locations GROUP BY location_type",
    ("locations",),
)
def centroid(t):
    """Mean position per location type."""
    out = spatial.centroid(t.locations, ["location_type"])
    return out.select("location_type", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "points")


@query(
    "density_grid",
    "A28",
    "SELECT floor(latitude / 10) * 10 AS south, floor(longitude / 10) * 10 AS west, count(*) AS points FROM locations GROUP BY 1, 2",
    ("locations",),
)
def density_grid(t):
    """Points per ten-degree cell."""
    out = spatial.density(t.locations, 10.0)
    return out.select(F.col("south").cast("double").alias("south"), F.col("west").cast("double").alias("west"), "points")


_DBSCAN = """WITH RECURSIVE e AS (SELECT a.id AS s, b.id AS d FROM locations_dense a, locations_dense b WHERE a.id <> b.id
      AND sqrt(pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2)) <= 0.01),
    r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s),
    l AS (SELECT p.id, CASE WHEN min(r.d) IS NOT NULL THEN least(p.id, min(r.d)) END AS cluster FROM locations_dense p LEFT JOIN r ON r.s = p.id GROUP BY p.id)"""


@query("dbscan", "L17 F28", _DBSCAN + " SELECT id, cluster FROM l", ("locations_dense",))
def dbscan(t):
    """Density clusters with eps 0.01 degrees and two points; noise is null."""
    return cluster.dbscan(t.locations_dense, 0.01, 2)


@query(
    "dbscan_report",
    "L17 F28",
    _DBSCAN
    + """, c AS (SELECT cluster, count(*) AS num_points, avg(latitude) AS la, avg(longitude) AS lo FROM l JOIN locations_dense USING (id) WHERE cluster IS NOT NULL GROUP BY cluster)
    SELECT row_number() OVER (ORDER BY cluster) AS cluster_id, num_points, round(la, 6) AS latitude, round(lo, 6) AS longitude,
      CASE WHEN num_points > 5 THEN 'high' ELSE 'low' END AS density FROM c""",
    ("locations_dense",),
)
def dbscan_report(t):
    """Size, centroid and density class of every cluster."""
    points = t.locations_dense
    out = cluster.cluster_report(points, cluster.dbscan(points, 0.01, 2))
    return out.select("cluster_id", "num_points", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "density")


@query("kmeans_hotspots", "L16 F28")
def kmeans_hotspots(t):
    """Three hotspot centres with their share of the points (seeded iteration, so without SQL)."""
    return cluster.hotspots(t.locations_dense)
