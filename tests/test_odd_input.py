"""Nulls, text order columns, appended files, unordered streams: input that must not change or lose rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import astro, geo, labels
from tidemark.operators import graph, limiter, monitor, relational, spatial, stages, training, vector, windows
from tidemark.session import scratch_path
from tidemark.sources import files
from tidemark.streaming import operators as st


def test_formulas_keep_null(spark):
    df = spark.createDataFrame([(None, None), (1.0, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    cols = {
        "hav": geo.haversine_km(a, b, F.lit(0.0), F.lit(0.0)),
        "geo": geo.geodesic_km(a, b, F.lit(0.0), F.lit(0.0)),
        "sep": astro.separation_degrees(a, b, F.lit(0.0), F.lit(0.0)),
        "lat": astro.rotate(a, b, "icrs", "galactic")["lat"],
        "clip": labels.clip(a, 0.0, 5.0),
        "axis": geo.axis_index(a, 3),
    }
    none, full = df.select(*[c.alias(n) for n, c in cols.items()]).orderBy(F.col("hav").asc_nulls_first()).collect()
    assert all(v is None for v in none) and all(v is not None for v in full)


def test_log_loss_skips_null(spark):
    df = spark.createDataFrame([(1, 0.5), (0, None), (None, 0.5)], "y int, p double")
    r = monitor.log_loss(df, "y", "p").first()
    assert r["log_loss"] == pytest.approx(math.log(2)) and r["accuracy"] == 1.0


def test_route_starts_at_zero(spark):
    stops = spark.createDataFrame([("r", 1, 0.0, 0.0), ("r", 2, 0.0, 1.0), ("r", 3, None, 1.0)], "route_id string, seq int, latitude double, longitude double")
    legs = [r["leg_km"] for r in spatial.route_legs(stops).orderBy("seq").collect()]
    assert legs[0] == 0 and legs[1] == pytest.approx(111.19, abs=0.01) and legs[2] == 0


def test_radius_without_a_centre(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "id int, latitude double, longitude double")
    centers = spark.createDataFrame([(1, 0.0, 0.0), (2, None, None)], "center_id int, latitude double, longitude double")
    got = spatial.within_radius(points, centers, 10.0).select("center_id", "id").collect()
    assert [tuple(r) for r in got] == [(1, 1)]


def test_null_keys_stay(spark):
    split = training.stratified_split(spark.createDataFrame([(None if i % 5 == 0 else i, "x") for i in range(100)], "id int, y string"), "id", "y")
    assert sum(part.count() for part in split) == 100
    t0 = dt.datetime(2024, 1, 1)
    rows = [(None if i % 2 else 7, i, None if i == 9 else t0 + dt.timedelta(seconds=i)) for i in range(40)]
    calls = spark.createDataFrame(rows, "k long, e int, ts timestamp")
    for out in (limiter.sliding_log(calls, "k", "e", "ts", 2, 4.0), limiter.token_bucket(calls, "k", "e", "ts", 60.0, 2)):
        got = out.collect()
        assert len(got) == 40 and sum(r["allowed"] is None for r in got) == 1
    log = {r["event"]: r["allowed"] for r in limiter.sliding_log(calls, "k", "e", "ts", 2, 4.0).collect()}
    # every other second per key: of each 4 s window (two calls) all are allowed, the null key like the other
    assert all(log[i] for i in range(40) if i != 9)


def test_null_bins_and_targets(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 0), ("a", 0)], "b string, y int")
    r = stages.mutual_information(df, {"b": F.col("b")}, "y").first()
    assert r["mutual_information"] == pytest.approx(math.log(2))
    t = spark.createDataFrame([("u", 10.0), ("v", 20.0), ("v", None), ("w", None)], "c string, y double")
    assert stages.TargetEncode("c", "y").fit(t).default == pytest.approx(15.0)


def test_text_order_column(spark):
    rows = [(f"k{i % 3}", f"name{i:05d}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o string, v int")
    out = windows.neighbour(df, ["k"], ["o"], {"v": "before"}, target_rows=10)
    assert {(r["v"], r["before"]) for r in out.collect()} == {(i, i - 3 if i >= 3 else None) for i in range(200)}


def test_arrow_files_append_and_overwrite(spark):
    path = scratch_path(spark, "arrow") + ".feather"
    files.write_table(spark.range(100).repartition(4), path)
    files.write_table(spark.range(100, 150).repartition(2), path, mode="append")
    assert files.read_table(spark, path).count() == 150
    files.write_table(spark.range(10).repartition(2), path)
    assert files.read_table(spark, path).count() == 10
    files.write_table(spark.range(0), path)
    back = files.read_table(spark, path)
    assert back.columns == ["id"] and back.count() == 0
    with pytest.raises(ValueError):
        files.write_table(spark.range(1), path, partition_by=["id"])


def test_precedes_pairs(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", i, t0 + dt.timedelta(hours=h)) for i, h in ((1, 0), (2, 1), (3, 1), (4, 2), (5, 30))]
    got = graph.precedes(spark.createDataFrame(rows, "r string, id int, ts timestamp"), "r", "ts", "id", 0.5).collect()
    assert {(r["source_id"], r["target_id"]) for r in got} == {(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)}


def test_first_new_row_and_childless_runs(spark):
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "")], "id int, t string")
    assert [tuple(r) for r in relational.insert_absent(new.limit(0), new, "id", "t").collect()] == [(1, "a")]
    runs = spark.createDataFrame([(1, "ml", "completed", None), (2, "ml", "failed", 1)], "id int, agent_type string, status string, parent_execution_id int")
    assert {r["id"]: (r["children"], r["failed"]) for r in relational.execution_tree(runs).collect()} == {1: (1, 1), 2: (0, 0)}


def test_null_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "id long, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in vector.topk_cosine(q, c).collect()] == [(1, 1)]
    index = vector.CoarseIndex(c.filter("embedding IS NOT NULL"), lists=2)
    assert index.search(q.limit(0)).count() == 0


def test_streams_do_not_depend_on_their_cuts(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 4, i, t0 + dt.timedelta(minutes=(i * 37) % 600), "a", "completed", 1.0) for i in range(240)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, agent_type string, status string, execution_time_ms double")
    results = []
    for cuts in (1, 6):
        base = scratch_path(spark, "cuts")
        for part in range(cuts):
            df.filter(F.col("event_id") % cuts == part).coalesce(1).write.mode("append").parquet(base)
        stream = lambda: st.read_stream(spark, base, df.schema, "ts", files_per_trigger=1)
        totals = {(r["window_start"], r["total"]) for r in st.run_windows(stream(), "w", "ts", ["agent_type"], "2 hours").collect()}
        with st.with_rocksdb(spark):
            seen = st.run_available(st.limited(stream(), "ts", st.SlidingLog(2, 3_600_000_000)), "l")
        assert seen.count() == 240
        out = st.settled(seen, lambda e: limiter.sliding_log(e, "key", "event_id", "ts", 2, 3600))
        results.append((totals, {(r["event_id"], r["allowed"]) for r in out.collect()}))
    assert results[0] == results[1] and sum(n for _, n in results[0][0]) == 240 and len(results[0][1]) == 240


def test_failed_or_self_reading_overwrite_keeps_the_data(spark, tmp_path):
    path = str(tmp_path / "own.feather")
    files.write_table(spark.range(10), path)
    files.write_table(files.read_table(spark, path).filter("id > 3"), path)
    assert files.read_table(spark, path).count() == 6
    with pytest.raises(Exception, match="no such row"):
        files.write_table(spark.range(5).withColumn("x", F.when(F.col("id") == 4, F.raise_error(F.lit("no such row")))), path)
    assert files.read_table(spark, path).count() == 6 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["own.feather"]


def test_updates_with_a_repeated_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "id int, name string")
    with pytest.raises(ValueError, match="more than once"):
        relational.update_by_key(df, twice, "id")
    nulls = spark.createDataFrame([(None, "x"), (None, "y")], "id int, name string")
    assert relational.update_by_key(df, nulls, "id").count() == 2
