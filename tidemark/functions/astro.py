"""Astronomy formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Light years per parsec, km and AU per light year, absolute magnitude of the sun,
# days per year, mean orbital speed of the earth.
PARSEC_TO_LY = 3.26156
LY_TO_KM = 9.461e12
LY_TO_AU = 63241.1
SUN_ABSOLUTE_MAGNITUDE = 4.83
YEAR_DAYS = 365.25
EARTH_SPEED_KM_S = 29.78

# Rotation from ICRS to galactic axes (J2000).
GALACTIC = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)


def distance_units(ly: Column) -> dict[str, Column]:
    """A distance in light years as parsec, km and AU."""
    return {
        "distance_parsecs": F.round(ly / PARSEC_TO_LY, 4),
        "distance_km": ly * F.lit(LY_TO_KM),
        "distance_au": ly * F.lit(LY_TO_AU),
    }


def absolute_magnitude(apparent: Column, parsecs: Column) -> Column:
    return apparent - F.lit(5.0) * (F.log10(parsecs) - 1)


def luminosity_ratio(absolute: Column) -> Column:
    """Luminosity relative to the sun."""
    return F.pow(F.lit(10.0), (F.lit(SUN_ABSOLUTE_MAGNITUDE) - absolute) / 2.5)


def parallax(mas: Column) -> dict[str, Column]:
    """Distance from a parallax in milliarcseconds; a zero parallax gives null."""
    pc = F.try_divide(F.lit(1000.0), mas)
    return {"distance_parsecs": F.round(pc, 2), "distance_light_years": F.round(pc * PARSEC_TO_LY, 2)}


def orbit(a: Column, e: Column, t: Column) -> dict[str, Column]:
    """Kepler quantities of a heliocentric orbit with semi-major axis a (AU), eccentricity e, t days after perihelion."""
    years = F.pow(a, F.lit(1.5))
    days = years * YEAR_DAYS
    near, far = a * (1 - e), a * (1 + e)
    bound = e < 1
    return {
        "perihelion_au": F.round(near, 4),
        "aphelion_au": F.round(far, 4),
        "period_days": F.round(days, 2),
        "period_years": F.round(years, 2),
        "mean_anomaly_degrees": F.round(F.pmod(t / days * 360, F.lit(360.0)), 2),
        "mean_distance_au": F.round(near + (far - near) * 0.5, 3),
        "circular_velocity_km_s": F.lit(EARTH_SPEED_KM_S) * F.sqrt(F.lit(2.0) / a - F.lit(1.0) / a),
        "is_closed_orbit": bound,
        "orbit_shape": F.when(bound, "elliptical").otherwise("hyperbolic"),
        "energy": F.when(bound, "negative").otherwise("positive"),
    }


def separation_degrees(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle on the sky."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    s, t = F.sin((d2 - d1) / 2), F.sin((F.radians(ra2) - F.radians(ra1)) / 2)
    h = s * s + F.cos(d1) * F.cos(d2) * t * t
    return F.degrees(F.lit(2.0) * F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h))))


def rotate(lon: Column, lat: Column, source: str, target: str) -> dict[str, Column]:
    """Coordinates in another frame: icrs to galactic and back; other pairs give null and a reason."""
    pair = (source.lower(), target.lower())
    if pair[0] == pair[1]:
        return {"lon": lon, "lat": lat, "reason": F.lit(None).cast("string")}
    if pair == ("icrs", "galactic"):
        m = GALACTIC
    elif pair == ("galactic", "icrs"):
        m = tuple(zip(*GALACTIC))
    else:
        none = F.lit(None).cast("double")
        return {"lon": none, "lat": none, "reason": F.lit(f"no transform from {pair[0]} to {pair[1]}")}
    p, q = F.radians(lat), F.radians(lon)
    v = (F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))
    x, y, z = (r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in m)
    return {
        "lon": F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)),
        "lat": F.degrees(F.asin(F.when(z > 1.0, 1.0).when(z < -1.0, -1.0).otherwise(z))),
        "reason": F.lit(None).cast("string"),
    }


def cone_search(stars: DataFrame, ra: float, dec: float, radius_deg: float, limit: int = 100) -> DataFrame:
    """Stars within an angle of a centre, nearest first; the declination band reaches the scan."""
    band = stars.filter(F.col("dec_deg").between(dec - radius_deg, dec + radius_deg))
    sep = separation_degrees(F.col("ra_deg"), F.col("dec_deg"), F.lit(float(ra)), F.lit(float(dec)))
    return band.withColumn("separation_deg", sep).filter(F.col("separation_deg") <= radius_deg).orderBy("separation_deg", "star_id").limit(limit)


def variability(curves: DataFrame) -> DataFrame:
    """Per object: mean, population deviation, range, index in percent of the mean, class."""
    std = F.stddev_pop("magnitude")
    one = curves.groupBy("object_id").agg(
        F.avg("magnitude").alias("mean"), std.alias("std"), F.min("magnitude").alias("min_magnitude"), F.max("magnitude").alias("max_magnitude")
    )
    kind = F.when(F.col("std") > 0.2, "highly_variable").when(F.col("std") > 0.05, "moderately_variable").otherwise("stable")
    return one.select(
        "object_id",
        F.round("mean", 3).alias("mean_magnitude"),
        F.round("std", 3).alias("std_deviation"),
        "min_magnitude",
        "max_magnitude",
        F.round(F.col("max_magnitude") - F.col("min_magnitude"), 3).alias("amplitude"),
        F.when(F.col("mean") > 0, F.round(F.col("std") / F.when(F.col("mean") > 0, F.col("mean")) * 100, 2)).otherwise(0.0).alias("variability_index"),
        (F.col("std") > 0.05).alias("is_variable"),
        kind.alias("variability_class"),
    )


def periods(curves: DataFrame, days: list[float], time_days: Column) -> DataFrame:
    """Strength of each trial period per object from one pass of sine and cosine sums.

    Every observation adds to one partial sum per trial period, combined on the map side. The sums of
    plain sines and cosines take the mean out afterwards, so no second pass is needed.
    """
    trial = F.explode(F.array(*[F.lit(float(d)) for d in days])).alias("period_days")
    rows = curves.select("object_id", time_days.alias("t"), F.col("magnitude").alias("m"), trial)
    angle = F.lit(6.283185307179586) * F.col("t") / F.col("period_days")
    rows = rows.select("object_id", "period_days", "m", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    sums = rows.groupBy("object_id", "period_days").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("m").alias("mean"),
        F.sum("c").alias("c"),
        F.sum("s").alias("s"),
        F.sum(F.col("m") * F.col("c")).alias("mc"),
        F.sum(F.col("m") * F.col("s")).alias("ms"),
    )
    re, im = F.col("mc") - F.col("mean") * F.col("c"), F.col("ms") - F.col("mean") * F.col("s")
    return sums.select("object_id", "period_days", (F.lit(2.0) * F.sqrt(re * re + im * im) / F.col("n")).alias("amplitude"))


def best_period(powers: DataFrame) -> DataFrame:
    """The strongest trial period per object, the shorter one on ties."""
    best = F.max(F.struct("amplitude", (-F.col("period_days")).alias("neg"))).alias("b")
    return powers.groupBy("object_id").agg(best).select("object_id", (-F.col("b.neg")).alias("period_days"), F.col("b.amplitude").alias("amplitude"))
