"""GeoJSON shapes as struct columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(properties: list[str], lat: str = "latitude", lon: str = "longitude") -> Column:
    """A Feature with a Point geometry."""
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )


def collection(df: DataFrame, properties: list[str], key: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of rows as a FeatureCollection text; the page size bounds what is gathered."""
    page = df.orderBy(key).offset(offset).limit(limit)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), feature(properties).alias("f"))))
    whole = F.struct(
        F.lit("FeatureCollection").alias("type"),
        F.transform(F.col("p"), lambda x: x["f"]).alias("features"),
        F.size("p").alias("count"),
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
    )
    return page.agg(pairs.alias("p")).select(F.to_json(whole).alias("collection"))
