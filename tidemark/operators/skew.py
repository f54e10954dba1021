"""Equi join whose hot keys are split by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], spread: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join in which a key holding more than ``hot_rows`` rows of ``big`` becomes several.

    The counts are combined on the map side; at most ``rows / hot_rows`` keys are hot, and Spark broadcasts their
    table only if its measured size allows. ``spread`` names a column of ``big`` that tells its rows
    apart; the rows of ``other`` with a hot key are repeated once per part.
    """
    hot = big.groupBy(*keys).count().filter(F.col("count") > hot_rows)
    hot = hot.select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    left = big.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__parts")
    right = other.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")
