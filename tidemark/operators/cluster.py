"""Density clusters and hotspots over coordinates."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import planar_distance
from tidemark.operators.components import connected_components
from tidemark.operators.skew import salted_join
from tidemark.operators.windows import global_index
from tidemark.session import cut_lineage

REFINE = 2  # each refinement halves a cell side twice
LEVELS = 3
PAIR_LIMIT = 1024

# cells of side eps/sqrt(2) that can hold a point within eps of a given cell
NEIGHBOURS = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0) and abs(i) + abs(j) < 4]
HALF = [n for n in NEIGHBOURS if n > (0, 0)]


def dbscan(points: DataFrame, eps: float = 0.01, min_samples: int = 2) -> DataFrame:
    """``(id, cluster)`` in plain degrees; noise has a null cluster, others the smallest point id of their cluster.

    The grid has cells of side eps/sqrt(2): all points of a cell are within eps of each other, so a cell
    with ``min_samples`` points is core as a whole and its inner pairs are never listed. Only points of
    sparser cells count their neighbours one by one, and clusters are connected components over cells.
    A border point goes to the neighbouring cluster with the smallest name.
    """
    side = eps / math.sqrt(2.0)
    unit = side / (1 << (REFINE * LEVELS))
    # copies of a position count as one site with a weight
    sites = points.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("site"))
    sites = sites.withColumns(
        {"fi": F.floor(F.col("latitude") / unit).cast("bigint"), "fj": F.floor(F.col("longitude") / unit).cast("bigint")}
    )
    sites = sites.withColumns({"ci": F.shiftright("fi", REFINE * LEVELS), "cj": F.shiftright("fj", REFINE * LEVELS)})
    weights = sites.groupBy("ci", "cj").agg(F.sum("w").alias("cell_w"))
    sites = cut_lineage(sites.join(weights, ["ci", "cj"]))

    sparse = sites.filter(F.col("cell_w") < min_samples)
    near = _near_pairs(sparse, sites, eps)
    outside = near.groupBy("site").agg(F.sum("other_w").alias("outside"))
    core_sparse = sparse.join(outside, "site", "left").filter(F.col("cell_w") + F.coalesce("outside", F.lit(0)) >= min_samples)
    core = sites.filter(F.col("cell_w") >= min_samples).unionByName(core_sparse.select(*sites.columns))
    core = cut_lineage(core)

    # a cell is named by its smallest core site
    cells = core.groupBy("ci", "cj").agg(F.min("site").alias("node"), F.count(F.lit(1)).alias("n"))
    edges = _core_edges(core, cells, eps)
    named = connected_components(cells.select("node"), edges)
    owners = cells.select("ci", "cj", "node").join(named, "node").select("ci", "cj", F.col("component"))
    core_named = core.select("site", "ci", "cj", "latitude", "longitude", "w").join(owners, ["ci", "cj"])

    loose = sparse.join(core.select("site"), "site", "left_anti")
    # a sparse, non-core point may sit in a cell that holds a core point
    same_cell = loose.select("site", "ci", "cj").join(owners, ["ci", "cj"]).select("site", "component")
    other_cell = _near_pairs(loose, core_named, eps, ["component"]).select("site", "component")
    border = same_cell.unionByName(other_cell).groupBy("site").agg(F.min("component").alias("component"))

    site_cluster = core_named.select("site", "component").unionByName(border)
    by_place = sites.select("site", "latitude", "longitude").join(site_cluster, "site", "left")
    placed = points.join(by_place, ["latitude", "longitude"]).select("id", "component")
    # rename every cluster by its smallest point id, border points included
    names = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("cluster"))
    return placed.join(names, "component", "left").select("id", "cluster")


def _near_pairs(some: DataFrame, others: DataFrame, eps: float, keep: list[str] | None = None) -> DataFrame:
    """Sites of ``others`` in neighbouring cells within eps of each site of ``some``."""
    shifts = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in NEIGHBOURS])
    a = some.select("site", F.col("latitude").alias("a_lat"), F.col("longitude").alias("a_lon"), "ci", "cj", F.explode(shifts).alias("s"))
    a = a.select("site", "a_lat", "a_lon", (F.col("ci") + F.col("s.di")).alias("ci"), (F.col("cj") + F.col("s.dj")).alias("cj"))
    b = others.select("ci", "cj", F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon"), F.col("w").alias("other_w"), *(keep or []))
    close = planar_distance(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= eps
    return salted_join(b, a, ["ci", "cj"], "b_lat").filter(close).select("site", "other_w", *(keep or []))


def _core_edges(core: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """Pairs of neighbouring cells with two core sites within eps.

    A pair of cells with few sites is tested site by site. A larger pair is split into ever smaller
    sub-cells with tight boxes: boxes further apart than eps drop out, boxes wholly within eps (or whose
    first sites are) settle the pair, and only what is left is split again.
    """
    shifts = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in HALF])
    a = cells.select(F.col("node").alias("src"), F.explode(shifts).alias("s"), "ci", "cj")
    a = a.select("src", (F.col("ci") + F.col("s.di")).alias("ci"), (F.col("cj") + F.col("s.dj")).alias("cj"))
    pairs = a.join(cells.select("ci", "cj", F.col("node").alias("dst")), ["ci", "cj"]).select("src", "dst")

    def boxes(level: int) -> DataFrame:
        drop = REFINE * (LEVELS - level)
        key = [F.shiftright("fi", drop).alias("bi"), F.shiftright("fj", drop).alias("bj")]
        up = REFINE if level else 0
        return core.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("latitude").alias("south"),
            F.max("latitude").alias("north"),
            F.min("longitude").alias("west"),
            F.max("longitude").alias("east"),
            F.min(F.struct("latitude", "longitude")).alias("first"),
        ).withColumns({"pi": F.shiftright("bi", up), "pj": F.shiftright("bj", up)})

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns])

    grid = boxes(0)
    place = cells.select(F.col("node"), F.col("ci"), F.col("cj"))
    open_pairs = (
        pairs.join(place.select(F.col("node").alias("src"), F.col("ci").alias("a_bi"), F.col("cj").alias("a_bj")), "src")
        .join(place.select(F.col("node").alias("dst"), F.col("ci").alias("b_bi"), F.col("cj").alias("b_bj")), "dst")
        .join(side(grid, "a"), ["a_bi", "a_bj"])
        .join(side(grid, "b"), ["b_bi", "b_bj"])
    )
    settled: list[DataFrame] = []
    for level in range(LEVELS + 1):
        judged = cut_lineage(open_pairs.withColumn("verdict", _verdict(eps)).filter("verdict <> 'apart'"))
        settled.append(judged.filter("verdict = 'joined'").select("src", "dst"))
        done = judged.filter("verdict = 'joined'").select("src", "dst").distinct()
        rest = judged.filter("verdict = 'open'").join(done, ["src", "dst"], "left_anti")
        small = F.lit(True) if level == LEVELS else F.col("a_n") * F.col("b_n") <= PAIR_LIMIT
        settled.append(_exact_edges(rest.filter(small), core, level, eps))
        if level == LEVELS:
            break
        big = rest.filter(~small).select(
            "src", "dst", F.col("a_bi").alias("a_pi"), F.col("a_bj").alias("a_pj"), F.col("b_bi").alias("b_pi"), F.col("b_bj").alias("b_pj")
        )
        if not big.limit(1).count():
            break
        grid = boxes(level + 1)
        open_pairs = big.join(side(grid, "a"), ["a_pi", "a_pj"]).join(side(grid, "b"), ["b_pi", "b_pj"])
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _verdict(eps: float) -> Column:
    def gap(lo: str, hi: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.col(f"b_{lo}") - F.col(f"a_{hi}"))

    def span(lo: str, hi: str) -> Column:
        return F.greatest(F.col(f"a_{hi}") - F.col(f"b_{lo}"), F.col(f"b_{hi}") - F.col(f"a_{lo}"))

    least = F.sqrt(gap("south", "north") * gap("south", "north") + gap("west", "east") * gap("west", "east"))
    most = F.sqrt(span("south", "north") * span("south", "north") + span("west", "east") * span("west", "east"))
    first = planar_distance(F.col("a_first.latitude"), F.col("a_first.longitude"), F.col("b_first.latitude"), F.col("b_first.longitude"))
    # a rounding margin only sends borderline boxes on to the exact test
    return F.when(least > eps * (1 + 1e-9), "apart").when((most < eps * (1 - 1e-9)) | (first <= eps), "joined").otherwise("open")


def _exact_edges(rest: DataFrame, core: DataFrame, level: int, eps: float) -> DataFrame:
    drop = REFINE * (LEVELS - level)
    spots = core.select(F.shiftright("fi", drop).alias("bi"), F.shiftright("fj", drop).alias("bj"), "latitude", "longitude")

    def side(s: str) -> DataFrame:
        return spots.select(*[F.col(c).alias(f"{s}_{c}") for c in spots.columns])

    pairs = rest.select("src", "dst", "a_bi", "a_bj", "b_bi", "b_bj").join(side("a"), ["a_bi", "a_bj"]).join(side("b"), ["b_bi", "b_bj"])
    close = planar_distance(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude")) <= eps
    return pairs.filter(close).select("src", "dst")


def cluster_report(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Per cluster: running number by smallest id, size, centroid and density class."""
    sized = points.join(labels.filter("cluster IS NOT NULL"), "id").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("num_points"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )
    out = global_index(sized, ["cluster"], "cluster_id").withColumn("cluster_id", F.col("cluster_id") + 1)
    return out.withColumn("density", F.when(F.col("num_points") > 5, "high").otherwise("low"))


def hotspots(points: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """K-means centres with their share of the points."""
    n = points.limit(k).count()
    data = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="features").transform(points)
    model = KMeans(k=max(1, min(n, k)), seed=seed, featuresCol="features", predictionCol="hotspot").fit(data)
    counts = model.transform(data).groupBy("hotspot").agg(F.count(F.lit(1)).alias("points"))
    centers = points.sparkSession.createDataFrame(
        [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())], "hotspot int, latitude double, longitude double"
    )
    total = points.agg(F.count(F.lit(1))).scalar()
    out = centers.join(counts, "hotspot").withColumn("intensity", F.col("points") / total)
    return out.withColumn("significance", F.when(F.col("points") > total / F.lit(float(len(model.clusterCenters()))), "high").otherwise("medium"))
