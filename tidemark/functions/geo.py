"""Distances, unit vectors and grid cells as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius (km), WGS84 ellipsoid (km), unit factors from km.
EARTH_RADIUS_KM = 6371.0088
WGS84_A = 6378.137
WGS84_F = 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
KM_TO = {"km": 1.0, "miles": 0.621371, "meters": 1000.0}

# The sphere and the ellipsoid differ by less than this share in any distance.
ELLIPSOID_MARGIN = 1.006
CELL_BITS = 21


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s = F.sin((p2 - p1) / 2)
    t = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = s * s + F.cos(p1) * F.cos(p2) * t * t
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h)))  # least() would read null as 1


def _let(value: Column, body) -> Column:
    """Bind an intermediate struct once inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, steps: int = 25) -> Column:
    """Distance on the WGS84 ellipsoid by a fixed number of inverse-formula steps.

    Coincident points give 0; for nearly antipodal points, where the iteration does not settle, the
    great-circle distance is returned.
    """
    f, b = WGS84_F, WGS84_B
    u1 = F.atan(F.lit(1 - f) * F.tan(F.radians(lat1)))
    u2 = F.atan(F.lit(1 - f) * F.tan(F.radians(lat2)))
    dl = F.radians(lon2 - lon1)
    base = F.struct(
        F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), dl.alias("dl")
    )

    def angles(k: Column, lam: Column) -> Column:
        a = k["c2"] * F.sin(lam)
        c = k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam)
        sin_sigma = F.sqrt(a * a + c * c)
        cos_sigma = k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam)
        first = F.struct(sin_sigma.alias("ss"), cos_sigma.alias("cs"), (k["c1"] * k["c2"] * F.sin(lam)).alias("num"))

        def second(v: Column) -> Column:
            sin_alpha = F.coalesce(F.try_divide(v["num"], v["ss"]), F.lit(0.0))
            cos2 = F.lit(1.0) - sin_alpha * sin_alpha
            mid = F.when(cos2 > 1e-15, v["cs"] - F.lit(2.0) * k["s1"] * k["s2"] / F.greatest(cos2, F.lit(1e-15))).otherwise(0.0)
            return F.struct(
                v["ss"].alias("ss"),
                v["cs"].alias("cs"),
                F.atan2(v["ss"], v["cs"]).alias("sigma"),
                sin_alpha.alias("sa"),
                cos2.alias("cos2"),
                mid.alias("mid"),
            )

        return _let(first, second)

    def next_lambda(k: Column, lam: Column) -> Column:
        def body(v: Column) -> Column:
            c = F.lit(f / 16) * v["cos2"] * (F.lit(4.0) + F.lit(f) * (F.lit(4.0) - F.lit(3.0) * v["cos2"]))
            tail = v["sigma"] + c * v["ss"] * (v["mid"] + c * v["cs"] * (F.lit(2.0) * v["mid"] * v["mid"] - 1))
            return k["dl"] + (F.lit(1.0) - c) * F.lit(f) * v["sa"] * tail

        return _let(angles(k, lam), body)

    def distance(k: Column, lam: Column) -> Column:
        def body(v: Column) -> Column:
            usq = v["cos2"] * F.lit((WGS84_A**2 - b**2) / b**2)
            big_a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
            big_b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
            mid2 = v["mid"] * v["mid"]
            inner = v["cs"] * (2 * mid2 - 1) - big_b / 6 * v["mid"] * (4 * v["ss"] * v["ss"] - 3) * (4 * mid2 - 3)
            delta = big_b * v["ss"] * (v["mid"] + big_b / 4 * inner)
            return F.lit(b) * big_a * (v["sigma"] - delta)

        return _let(angles(k, lam), body)

    def solve(k: Column) -> Column:
        start = F.struct(k["dl"].alias("lam"), F.lit(math.inf).alias("move"))
        end = F.aggregate(
            F.array_repeat(F.lit(0), steps),
            start,
            # a longitude that gives itself again stays, so the steps left have nothing to do
            lambda st, _: F.when(st["move"] == 0.0, st).otherwise(
                _let(
                    F.struct(st["lam"].alias("old"), next_lambda(k, st["lam"]).alias("new")),
                    lambda p: F.struct(p["new"].alias("lam"), F.abs(p["new"] - p["old"]).alias("move")),
                )
            ),
        )
        return _let(end, lambda e: F.when(e["move"] < 1e-9, distance(k, e["lam"])))

    exact = _let(base, solve)
    same = (lat1 == lat2) & (lon1 == lon2)
    return F.when(same, F.lit(0.0)).otherwise(F.coalesce(exact, haversine_km(lat1, lon1, lat2, lon2)))


def convert_km(km: Column, unit: str = "km") -> Column:
    """Kilometres in the wanted unit, two decimals; an unknown unit reads as km."""
    return F.round(km * F.lit(KM_TO.get(unit, 1.0)), 2)


def unit_vector(lat: Column, lon: Column) -> dict[str, Column]:
    """Point on the unit sphere; distances over poles and antimeridian need no special case there."""
    p, q = F.radians(lat), F.radians(lon)
    return {"x": F.cos(p) * F.cos(q), "y": F.cos(p) * F.sin(q), "z": F.sin(p)}


def chord(km: float) -> float:
    """Straight-line distance on the unit sphere that belongs to a surface distance."""
    return 2.0 * math.sin(min(math.pi, km / EARTH_RADIUS_KM) / 2.0)


def axis_index(value: Column, bits: int) -> Column:
    """Index of a unit-sphere coordinate among ``2**bits`` slices of [-1, 1]."""
    top = (1 << bits) - 1
    at = F.greatest(F.lit(0), F.least(F.lit(top), F.floor((value + 1) / 2 * (1 << bits)))).cast("bigint")
    return F.when(value.isNotNull(), at)


def pack(ix: Column, iy: Column, iz: Column) -> Column:
    """Three slice numbers in one bigint."""
    return F.shiftleft(ix, 2 * CELL_BITS).bitwiseOR(F.shiftleft(iy, CELL_BITS)).bitwiseOR(iz)


def planar_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in plain degrees."""
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting against a closed or open ring of ``struct(lon, lat)`` points."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a = F.get(ring, i)
        b = F.get(ring, F.pmod(i + 1, n))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        rise = F.when(spans, b["lat"] - a["lat"])
        at = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / rise
        return F.when(spans & (lon < at), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i))
    return F.pmod(hits, F.lit(2)) == 1
