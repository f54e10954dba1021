"""Rule labels over named feature columns, and the value ranges of the synthetic features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Uniform ranges of the synthetic training features.
ASTEROID_RANGES = {
    "magnitude": (14.0, 22.0),
    "distance_au": (0.01, 0.5),
    "velocity_km_s": (5.0, 30.0),
    "moon_phase": (0.0, 1.0),
    "cloud_cover_percent": (0.0, 100.0),
    "object_altitude_deg": (10.0, 85.0),
    "observer_latitude": (8.0, 37.0),
}
LAND_RANGES = {
    "ndvi_current": (0.1, 0.8),
    "ndvi_3months_ago": (0.1, 0.8),
    "rainfall_anomaly_pct": (-60.0, 30.0),
    "temperature_avg": (20.0, 42.0),
}
DROUGHT_RANGES = {
    "soil_moisture": (0.04, 0.35),
    "rainfall_anomaly_pct": (-70.0, 40.0),
    "ndvi_delta": (-0.5, 0.1),
    "temperature_anomaly": (-2.0, 5.0),
}


def clip(value: Column, low: float, high: float) -> Column:
    """The value within bounds; null stays null."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def land_change() -> Column:
    """0 no change, 1 deforestation, 2 urbanisation, 3 drought stress; the first matching rule wins."""
    drop = F.col("ndvi_3months_ago") - F.col("ndvi_current")
    return (
        F.when((drop > 0.15) & (F.col("rainfall_anomaly_pct") < -20), 3)
        .when(drop > 0.25, 1)
        .when(drop > 0.10, 2)
        .otherwise(0)
    )


def drought_severity() -> Column:
    """Severity 0..5 from soil moisture, rainfall anomaly and temperature anomaly."""
    dry = F.lit(3.0) * (F.lit(0.20) - F.col("soil_moisture")) / 0.16
    rain = F.lit(2.0) * (-F.col("rainfall_anomaly_pct") / 70)
    heat = F.lit(0.5) * F.col("temperature_anomaly") / 5
    return clip(dry + rain + heat, 0.0, 5.0)


def observation_probability() -> Column:
    """Chance of a successful asteroid observation, 0..1."""
    weighted = (
        F.lit(0.3) * (F.lit(22) - F.col("magnitude")) / 8
        + F.lit(0.2) * (F.lit(0.5) - F.col("distance_au")) / 0.49
        + F.lit(0.25) * (F.lit(1) - F.col("cloud_cover_percent") / 100)
        + F.lit(0.15) * F.col("object_altitude_deg") / 85
        + F.lit(0.1) * (F.lit(1) - F.col("moon_phase"))
    )
    return clip(weighted, 0.0, 1.0)
