"""Synthetic training tables derived from an id column; the same id always gives the same row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.hashing import uniform


def _features(ids: DataFrame, ranges: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    return ids.withColumns(
        {name: F.lit(lo) + uniform(F.col("id"), seed, name) * (F.lit(hi) - F.lit(lo)) for name, (lo, hi) in ranges.items()}
    )


def _month(seed: int):
    return (F.floor(uniform(F.col("id"), seed, "month") * 12) + 1).cast("int")


def asteroid_rows(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Observation features, success probability and a 0/1 label drawn from it."""
    df = _features(ids, labels.ASTEROID_RANGES, seed).withColumn("probability", labels.observation_probability())
    return df.withColumn("label", (uniform(F.col("id"), seed, "label") < F.col("probability")).cast("int"))


def land_rows(ids: DataFrame, seed: int = 43) -> DataFrame:
    """Vegetation features and the land-change class."""
    return _features(ids, labels.LAND_RANGES, seed).withColumn("month", _month(seed)).withColumn("label", labels.land_change())


def drought_rows(ids: DataFrame, seed: int = 44) -> DataFrame:
    """Climate features and the severity target."""
    return _features(ids, labels.DROUGHT_RANGES, seed).withColumn("month", _month(seed)).withColumn("target", labels.drought_severity())


def ids(spark, n: int) -> DataFrame:
    """``n`` row ids, generated in parallel."""
    return spark.range(n)
