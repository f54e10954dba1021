"""Typed edges: traversal, neighbourhoods and derived edges."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import pearson
from tidemark.operators.skew import salted_join
from tidemark.operators.windows import order_value
from tidemark.session import cut_lineage


def bfs(edges: DataFrame, seeds: DataFrame, hops: int = 3, edge_types: list[str] | None = None) -> DataFrame:
    """``(seed, node, hop)``: nodes reached from each seed and the smallest number of hops.

    Every hop is written before the next one starts, so no hop is worked out twice.
    """
    steps = edges if edge_types is None else edges.filter(F.col("edge_type").isin(edge_types))
    steps = steps.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct()
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        frontier = (
            frontier.join(steps, "node")
            .select("seed", F.col("next").alias("node"), F.lit(hop).alias("hop"))
            .distinct()
            .join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        )
        frontier = cut_lineage(frontier)
        seen = seen.unionByName(frontier)
    return seen


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, neighbour, direction, edge_type)`` of the wanted nodes."""
    wanted = nodes.select("node").distinct()
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), F.lit("out").alias("direction"), "edge_type")
    inc = edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), F.lit("in").alias("direction"), "edge_type")
    return out.unionByName(inc).join(wanted, "node", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """Out and in degree per node."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("source_id").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target_id").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def new_edges(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Edges not stored yet."""
    return found.distinct().join(existing.select("source_id", "target_id", "edge_type"), ["source_id", "target_id", "edge_type"], "left_anti")


def confirmed_by(predictions: DataFrame, existing: DataFrame) -> DataFrame:
    """CONFIRMED_BY edges from correct predictions to their outcome record."""
    ok = predictions.filter(F.col("predicted_value").eqNullSafe(F.col("actual_value")))
    found = ok.select(F.col("id").alias("source_id"), F.col("outcome_id").alias("target_id"), F.lit("CONFIRMED_BY").alias("edge_type"))
    return new_edges(existing, found)


def precedes(events: DataFrame, region: str, ts: str, key: str, days: float) -> DataFrame:
    """PRECEDES edges from each event to every later one of its region within ``days``; equal instants give none.

    ``ts`` is an instant column. Time is cut into cells as long as the limit, so an event meets its own cell and the next:
    an equi join whose hot cells are split by measured size.
    """
    width = days * 86400000000.0
    rows = events.select(F.col(region).alias("region"), F.col(key).alias("key"), order_value(events, ts).alias("at"))
    rows = rows.withColumn("cell", F.floor(F.col("at") / F.lit(width))).filter("region IS NOT NULL AND at IS NOT NULL")
    later = rows.select("region", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"), F.col("key").alias("target_id"), F.col("at").alias("then"))
    gap = F.col("then") - F.col("at")
    pairs = salted_join(rows, later, ["region", "cell"], "key").filter((gap > 0) & (gap <= width))
    return pairs.select(F.col("key").alias("source_id"), "target_id", F.lit("PRECEDES").alias("edge_type"), (gap / 86400000000.0).alias("gap_days"))


def correlates_with(series: DataFrame, names: dict[str, Column], day: Column, threshold: float = 0.5) -> DataFrame:
    """CORRELATES_WITH edges between daily series: ``names`` maps a series to its daily aggregate."""
    daily = series.groupBy(day.alias("day")).agg(*[agg.alias(n) for n, agg in names.items()])
    pairs = list(combinations(names, 2))
    one = daily.agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("source_id"), F.lit(b).alias("target_id"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows)).filter(F.abs("r") > threshold).withColumn("edge_type", F.lit("CORRELATES_WITH"))
