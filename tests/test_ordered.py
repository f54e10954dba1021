"""Ordered operators with their buckets made tiny, against plain single-task windows and Python folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import limiter, monitor, training, windows
from tidemark.operators.ledger import chain, verify


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [(i, 0 if i % 3 else rnd.randrange(5), i * 1000 + rnd.randrange(500), None if rnd.random() < 0.6 else rnd.random()) for i in range(600)]
    return spark.createDataFrame(data, "id long, k int, ts long, v double")


def as_map(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("target", [7, 50, 10**6])
@pytest.mark.parametrize("forward", [True, False])
def test_fill(rows, target, forward):
    order = [F.asc("ts"), F.asc("id")] if forward else [F.desc("ts"), F.desc("id")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = as_map(rows.withColumn("v", F.last("v", True).over(w)), "v")
    assert as_map(windows.fill(rows, ["k"], ["ts", "id"], ["v"], forward, target), "v") == want


@pytest.mark.parametrize("target", [7, 10**6])
def test_neighbour_and_running_sum(rows, target):
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = as_map(rows.select("id", F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n")), "p", "n")
    back = as_map(windows.neighbour(rows, ["k"], ["ts", "id"], {"id": "p"}, target_rows=target), "p")
    ahead = as_map(windows.neighbour(rows, ["k"], ["ts", "id"], {"id": "n"}, following=True, target_rows=target), "n")
    assert {i: (back[i][0], ahead[i][0]) for i in back} == want
    full = rows.withColumn("one", F.lit(1.0))
    want = as_map(full.select("id", F.sum("one").over(w).alias("s")), "s")
    assert as_map(windows.running_sum(full, ["k"], ["ts", "id"], "one", "s", target), "s") == want


def test_buckets_are_balanced(rows):
    sizes = [r["count"] for r in windows.with_order_buckets(rows, ["ts", "id"], 50).groupBy(windows.BUCKET).count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 60


def test_one_instant_with_a_third_of_the_rows(spark):
    data = [(i, 1, 500 if i % 3 == 0 else i, None if i % 4 else float(i)) for i in range(900)]
    df = spark.createDataFrame(data, "id long, k int, ts long, v double")
    sizes = [r["count"] for r in windows.with_order_buckets(df, ["ts", "id"], 50).groupBy(windows.BUCKET).count().collect()]
    assert max(sizes) <= 110
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = as_map(df.select("id", F.lag("id").over(w).alias("p")), "p")
    assert as_map(windows.neighbour(df, ["k"], ["ts", "id"], {"id": "p"}, target_rows=50), "p") == want
    want = as_map(df.withColumn("v", F.last("v", True).over(w)), "v")
    assert as_map(windows.fill(df, ["k"], ["ts", "id"], ["v"], True, 50), "v") == want


def test_global_index(rows):
    got = as_map(windows.global_index(rows.repartition(5), ["v", "id"], "pos"), "pos")
    order = sorted(rows.collect(), key=lambda r: ((0, 0.0) if r["v"] is None else (1, r["v"]), r["id"]))
    assert got == {r["id"]: (i,) for i, r in enumerate(order)}


def calls(seed, n=800):
    rnd = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        # bursts, pauses, and one key with most of the rows
        t += rnd.choice([0, 0, 200_000, 400_000, 900_000, 30_000_000 if i % 50 == 0 else 100_000])
        out.append((i, "hot" if i % 3 else f"u{rnd.randrange(4)}", t))
    return out


def replay_log(rows, limit, width):
    state, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        log = [x for x in state.get(k, []) if x > t - width]
        ok = len(log) < limit
        if ok:
            log.append(t)
        state[k] = log
        out[i] = (ok, max(0, limit - len(log)))
    return out


def replay_bucket(rows, per_minute, burst):
    state, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, last = state.get(k, (float(burst), t))
        tokens = min(float(burst), tokens + (t - last) / 1e6 * (per_minute / 60.0))
        ok = tokens >= 1
        state[k] = (tokens - 1 if ok else tokens, t)
        out[i] = ok
    return out


def frame(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, k, base + dt.timedelta(microseconds=t)) for i, k, t in rows], "id long, k string, ts timestamp_ntz")


@pytest.mark.parametrize("limit,window", [(1, 1.0), (3, 2.0), (20, 10.0)])
def test_sliding_log(spark, limit, window):
    rows = calls(limit)
    got = {r["event"]: (r["allowed"], r["remaining"]) for r in limiter.sliding_log(frame(spark, rows), "k", "id", "ts", limit, window).collect()}
    assert got == replay_log(rows, limit, int(window * 1e6))


@pytest.mark.parametrize("per_minute,burst", [(60, 3), (600, 2), (20, 5)])
def test_token_bucket(spark, per_minute, burst):
    rows = calls(burst + 10)
    got = {r["event"]: r["allowed"] for r in limiter.token_bucket(frame(spark, rows), "k", "id", "ts", per_minute, burst).collect()}
    assert got == replay_bucket(rows, per_minute, burst)


def test_limiter_fixture_cases(spark):
    burst = frame(spark, [(i, "a", 0) for i in range(4)])
    got = [r["allowed"] for r in limiter.sliding_log(burst, "k", "id", "ts", 3, 60).orderBy("event").collect()]
    assert got == [True, True, True, False]
    later = frame(spark, [(0, "a", 0), (1, "a", 0), (2, "a", 0), (3, "a", 1_100_000)])
    got = [r["allowed"] for r in limiter.sliding_log(later, "k", "id", "ts", 2, 1).orderBy("event").collect()]
    assert got == [True, True, False, True]


def test_ledger_chain_and_tamper(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", f"h{i}") for i in range(20)], "id long, agent string, output_hash string")
    good = chain(df, ["agent"], ["id"])
    assert verify(good, ["agent"], ["id"]).filter("NOT valid").count() == 0
    bad = good.withColumn("output_hash", F.when(F.col("id") == 6, "x").otherwise(F.col("output_hash")))
    assert [r["id"] for r in verify(bad, ["agent"], ["id"]).filter("NOT valid").collect()] == [8]


def test_auc_edge_cases(spark):
    def auc(rows):
        return monitor.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()["auc"]

    assert auc([(0, 0.1), (1, 0.9)]) == 1.0
    assert auc([(0, 0.5), (1, 0.5)]) == 0.5
    assert auc([(1, 0.2), (1, 0.3)]) is None


def test_split_is_exact_and_stable(spark):
    df = spark.range(1003).select(F.col("id"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    train, test = training.stratified_split(df, "id", "y")
    sizes = {r["y"]: r["count"] for r in test.groupBy("y").count().collect()}
    assert sizes == {1: 61, 0: 140} or sizes == {1: 60, 0: 140}
    assert train.count() + test.count() == 1003
    again = training.stratified_split(df.repartition(7), "id", "y")[1]
    assert again.exceptAll(test).count() == 0


def test_unmeasured_metric_blocks_promotion(spark):
    metrics = spark.createDataFrame([("a", "accuracy", 0.95), ("b", "accuracy", 0.95), ("b", "auc", 0.9)], "model string, metric string, value double")
    gates = spark.createDataFrame([("production", "accuracy", 0.9), ("production", "auc", 0.8)], "stage string, metric string, minimum double")
    got = {r["model"]: r["passed"] for r in monitor.promotion(metrics, gates).collect()}
    assert got == {"a": False, "b": True}


def test_text_orders_are_split(spark):
    rows = [(i % 3 > 0, f"2024-0{i:05d}", "same" if i % 3 else f"t{i}", float(i) if i % 7 == 0 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "k boolean, at string, hot string, v double").repartition(7)
    for order in (["at"], ["hot", "at"]):
        sizes = [r["count"] for r in windows.with_order_buckets(df, order, 100).groupBy(windows.BUCKET).count().collect()]
        assert 15 <= len(sizes) <= 20 and max(sizes) < 300
    for forward in (True, False):
        got = {r["at"]: r["v"] for r in windows.fill(df, ["k"], ["at"], ["v"], forward, target_rows=100).collect()}
        for k in (True, False):
            own = sorted((r for r in rows if r[0] is k), key=lambda r: r[1], reverse=not forward)
            last = None
            for r in own:
                last = last if r[3] is None else r[3]
                assert got[r[1]] == last
