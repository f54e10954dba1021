"""Geometry against brute force, with hot spots, copies, poles and the antimeridian."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import cluster, spatial
from tidemark.operators.components import connected_components
from tidemark.operators.skew import salted_join


def hav(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    s, t = math.sin((q - p) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    return 2 * geo.EARTH_RADIUS_KM * math.asin(math.sqrt(min(1, s * s + math.cos(p) * math.cos(q) * t * t)))


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lit4(*v):
    return [F.lit(float(x)) for x in v]


def test_distances(spark):
    assert one(spark, geo.haversine_km(*lit4(34.0522, -118.2437, 34.0600, -118.2500))) == pytest.approx(1.0436, abs=1e-3)
    # published test line of the inverse problem on this ellipsoid family
    assert one(spark, geo.geodesic_km(*lit4(0, 0, 0, 1))) == pytest.approx(111.319491, abs=1e-5)
    assert one(spark, geo.geodesic_km(*lit4(0, 0, 1, 0))) == pytest.approx(110.574389, abs=1e-5)
    assert one(spark, geo.geodesic_km(*lit4(10, 20, 10, 20))) == 0.0
    assert one(spark, geo.geodesic_km(*lit4(0, 0, 0.1, 179.9))) == pytest.approx(20003.9, abs=60)
    assert one(spark, geo.convert_km(F.lit(10.0), "furlongs")) == 10.0
    assert one(spark, geo.convert_km(F.lit(10.0), "miles")) == 6.21


def scattered(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind < 2:  # one spot holds a third of all rows
            rows.append((i, 12.97 + rnd.random() * 1e-3, 77.59 + rnd.random() * 1e-3))
        elif kind == 2:  # copies of one position
            rows.append((i, 50.0, 8.0))
        elif kind == 3:
            rows.append((i, rnd.choice([89.9, -89.9]) + rnd.random() * 0.05, rnd.uniform(-180, 180)))
        elif kind == 4:
            rows.append((i, rnd.uniform(-5, 5), rnd.choice([-179.99, 179.99])))
        else:
            rows.append((i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)))
    return rows


@pytest.mark.parametrize("k,radius", [(1, None), (1, 300.0), (4, None), (4, 800.0)])
def test_nearest_equals_brute_force(spark, k, radius):
    points, queries = scattered(400, 1), scattered(120, 2)
    p = spark.createDataFrame(points, "id long, latitude double, longitude double")
    q = spark.createDataFrame(queries, "query_id long, latitude double, longitude double")
    got = {}
    for r in spatial.nearest(q, p, k, radius, leaf_sites=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], round(r["distance_km"], 5)))
    for qid, la, lo in queries:
        want = sorted((hav((la, lo), (b, c)), i) for i, b, c in points)
        want = [round(d, 5) for d, _ in want if radius is None or d <= radius][:k]
        assert [d for _, d in sorted(got.get(qid, []))] == pytest.approx(want, abs=2e-4)


def test_nearest_without_points(spark):
    p = spark.createDataFrame([], "id long, latitude double, longitude double")
    q = spark.createDataFrame([(1, 0.0, 0.0)], "query_id long, latitude double, longitude double")
    assert spatial.nearest(q, p).count() == 0


@pytest.mark.parametrize("radius", [0.05, 40.0, 2500.0])
def test_radius_join_equals_brute_force(spark, radius):
    points, centers = scattered(300, 3), scattered(60, 4)
    p = spark.createDataFrame(points, "id long, latitude double, longitude double")
    c = spark.createDataFrame(centers, "center_id long, latitude double, longitude double")
    got = sorted((r["center_id"], r["id"]) for r in spatial.within_radius(p, c, radius).collect())
    want = sorted((ci, i) for ci, a, b in centers for i, x, y in points if hav((a, b), (x, y)) <= radius)
    assert got == want


@pytest.mark.parametrize("lat,lon", [(0.0, 179.9), (89.5, 10.0), (-60.0, -179.5), (12.97, 77.59)])
def test_single_center_box_loses_nothing(spark, lat, lon):
    points = scattered(300, 5)
    p = spark.createDataFrame(points, "id long, latitude double, longitude double")
    got = sorted(r["id"] for r in spatial.nearby(p, lat, lon, 700.0, method="haversine").collect())
    assert got == sorted(i for i, x, y in points if hav((lat, lon), (x, y)) <= 700.0)


def test_salted_join_splits_hot_keys(spark):
    big = spark.range(300).select(F.col("id"), F.when(F.col("id") < 100, 7).otherwise(F.col("id")).alias("k"))
    small = spark.createDataFrame([(7, "a"), (7, "b"), (150, "c")], "k long, v string")
    plain = big.join(small, ["k"]).count()
    assert salted_join(big, small, ["k"], "id", hot_rows=9).count() == plain == 201


def test_overlap_pairs_come_once(spark):
    rnd = random.Random(5)

    def boxes(n):
        return [(i, s := rnd.uniform(-60, 40), w := rnd.uniform(-100, 80), s + rnd.uniform(0, 20), w + rnd.uniform(0, 20)) for i in range(n)]

    a, b = boxes(60), boxes(40)
    cols = "id long, south double, west double, north double, east double"
    got = sorted(tuple(r) for r in spatial.overlap_join(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), 3.0).collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4])
    assert got == want


def brute_dbscan(points, eps, m):
    near = {i: [j for j, x, y in points if math.sqrt((x - a) ** 2 + (y - b) ** 2) <= eps] for i, a, b in points}
    core = {i for i in near if len(near[i]) >= m}
    comp = {}
    for i in sorted(core):
        if i in comp:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j in comp:
                continue
            comp[j] = i
            todo += [k for k in near[j] if k in core and k not in comp]
    return near, core, comp


@pytest.mark.parametrize("m", [2, 4, 9])
@pytest.mark.parametrize("pair_limit", [0, 1024])
def test_dbscan_equals_brute_force(spark, monkeypatch, m, pair_limit):
    monkeypatch.setattr(cluster, "PAIR_LIMIT", pair_limit)
    rnd = random.Random(m)
    points = []
    for i in range(260):
        if i % 3 == 0:  # a dense disc next to others
            points.append((i, 5 + rnd.gauss(0, 0.01), 5 + rnd.gauss(0, 0.01)))
        elif i % 3 == 1:
            points.append((i, 5 + rnd.random() * 0.12, 5 + rnd.random() * 0.12))
        else:  # copies
            points.append((i, round(5 + rnd.random() * 0.1, 2), 5.05))
    eps = 0.008
    near, core, comp = brute_dbscan(points, eps, m)
    df = spark.createDataFrame(points, "id long, latitude double, longitude double")
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, eps, m).collect()}
    assert set(got) == {i for i, _, _ in points}
    # same partition of the core points
    groups, mine = {}, {}
    for i in core:
        groups.setdefault(comp[i], set()).add(i)
        mine.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    for i, _, _ in points:
        if i in core:
            continue
        touching = {got[j] for j in near[i] if j in core}
        assert (got[i] is None) == (not touching)
        assert got[i] is None or got[i] in touching


def test_components_on_a_long_chain_and_a_hub(spark):
    n = 60
    chain = [(i, i + 1) for i in range(n)]
    hub = [(100, 200 + i) for i in range(50)]
    edges = spark.createDataFrame(chain + hub, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), 100, *range(200, 250), 999]], "node long")
    got = {r["node"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(n + 1)} == {0}
    assert {got[i] for i in range(200, 250)} == {100} and got[999] == 999


def test_geocode_and_centroid_keep_zero(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (2.0, 4.0), (None, 1.0)], "latitude double, longitude double")
    row = spatial.centroid(pts).first()
    assert (row["latitude"], row["longitude"], row["points"]) == (1.0, 2.0, 2)


@pytest.mark.parametrize("radius,method,leaf", [(500.0, "haversine", 1), (500.0, "haversine", 64), (0.05, "haversine", 1), (9000.0, "geodesic", 2), (20_000.0, "haversine", 4)])
def test_counts_within_equal_listed_pairs(spark, radius, method, leaf):
    points, centers = scattered(600, 3), scattered(90, 4)
    p = spark.createDataFrame([*points, (9001, None, 1.0), (9002, 1.0, None)], "id long, latitude double, longitude double")
    c = spark.createDataFrame([*centers, (7, 12.97, 77.59), (None, 50.0, 8.0), (500, None, 1.0)], "center_id long, latitude double, longitude double")
    listed = spatial.within_radius(p, c, radius, method).groupBy("center_id")
    listed = listed.agg(F.count(F.lit(1)).alias("hits"), F.min("id").alias("first_id"), F.max("distance_km").alias("farthest_km")).collect()
    got = spatial.count_within(p, c, radius, method, leaf_sites=leaf, hot_rows=20).collect()
    assert {r["center_id"]: (r["hits"], r["first_id"]) for r in got} == {r["center_id"]: (r["hits"], r["first_id"]) for r in listed}
    assert {r["center_id"]: round(r["farthest_km"], 6) for r in got} == {r["center_id"]: round(r["farthest_km"], 6) for r in listed}
    for empty in (spatial.count_within(p.limit(0), c, radius, method), spatial.count_within(p, c.limit(0), radius, method)):
        assert empty.count() == 0


def test_counts_within_meet_the_border_only(spark):
    """Forty thousand points on a square, one ball: the last join meets a small share of the pairs."""
    p = spark.range(40_000).select("id", (F.col("id") % 200 / 100.0).alias("latitude"), (F.floor(F.col("id") / 200) / 100.0).alias("longitude"))
    c = spark.createDataFrame([(1, 1.0, 1.0)], "center_id int, latitude double, longitude double")
    met, real = [], spatial.salted_join
    spatial.salted_join = lambda *a, **k: met.append(out := real(*a, **k)) or out
    try:
        hits = spatial.count_within(p, c, 80.0, leaf_sites=4).first()["hits"]
    finally:
        spatial.salted_join = real
    assert hits == sum(hav((1.0, 1.0), (i % 200 / 100.0, i // 200 / 100.0)) <= 80.0 for i in range(40_000)) and hits > 15_000
    assert met[0].count() < hits / 4


def test_counts_within_meet_bags_for_many_centres_at_once(spark, monkeypatch):
    """Two thousand centres among two thousand points: the last join has rows of bags and areas, not of centres."""
    rnd = random.Random(11)
    at = lambda n: [(i, rnd.uniform(0, 5), rnd.uniform(0, 5)) for i in range(n)]
    points, centers = at(2000), at(2000)
    met, real = [], spatial.salted_join
    monkeypatch.setattr(spatial, "salted_join", lambda *a, **k: met.append(out := real(*a, **k)) or out)
    p, c = spark.createDataFrame(points, "id long, latitude double, longitude double"), spark.createDataFrame(centers, "center_id long, latitude double, longitude double")
    got = {r["center_id"]: (r["hits"], r["first_id"]) for r in spatial.count_within(p, c, 100.0).collect()}
    for i, *spot in centers[:50]:
        hits = [j for j, *q in points if hav(spot, q) <= 100.0]
        assert got.get(i) == ((len(hits), min(hits)) if hits else None)
    assert met[0].count() < len(centers)


@pytest.mark.parametrize("radius,method", [(0.05, "haversine"), (700.0, "haversine"), (700.0, "geodesic")])
def test_counts_within_in_small_areas_with_text_ids(spark, monkeypatch, radius, method):
    monkeypatch.setattr(spatial, "AREA", 8)
    monkeypatch.setattr(spatial, "TASK_BAGS", 2)
    points, centers = scattered(300, 6), scattered(60, 7)
    rows = [(f"p{i}" if i % 9 else None, x, y) for i, x, y in points] + [("a", float("nan"), 1.0), ("b", 1.0, math.inf)]
    p = spark.createDataFrame(rows, "id string, latitude double, longitude double")
    c = spark.createDataFrame([*centers, (99, float("nan"), 0.0)], "center_id long, latitude double, longitude double")
    listed = spatial.within_radius(p.fillna({"id": "~"}).filter("latitude < 91 AND longitude < 181"), c.filter("latitude < 91"), radius, method).groupBy("center_id")
    listed = listed.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("id") != "~", F.col("id"))).alias("first"), F.max("distance_km").alias("km")).collect()
    got = spatial.count_within(p, c, radius, method, leaf_sites=5, hot_rows=4)
    assert got.schema["first_id"].dataType.simpleString() == "string"
    got = {r["center_id"]: (r["hits"], r["first_id"], round(r["farthest_km"], 6)) for r in got.collect()}
    assert got == {r["center_id"]: (r["n"], r["first"], round(r["km"], 6)) for r in listed}


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_with_salted_spot(spark, k):
    rnd = random.Random(9)
    points = [(i, 12.97 + rnd.random() * 1e-5, 77.59 + rnd.random() * 1e-5) if i % 3 == 0 else (i, rnd.uniform(-60, 60), rnd.uniform(-180, 180)) for i in range(300)]
    queries = [(0, 12.970004, 77.590005), (1, 12.97, 77.6), (2, -10.0, 20.0)]
    got = spatial.nearest(
        spark.createDataFrame(queries, "query_id int, latitude double, longitude double"),
        spark.createDataFrame(points, "id int, latitude double, longitude double"), k, leaf_sites=8, hot_rows=10,
    ).collect()
    for q, *at in queries:
        want = sorted((round(hav(at, p[1:]), 8), p[0]) for p in points)[:k]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in want]
