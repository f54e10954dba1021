"""Long runs of the limiters: walked by instant, with the same answers as row by row."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators import limiter


def _stretches(rng, count):
    """Distinct instants with call counts: bursts, steady traffic and pauses."""
    us, now = [], 0
    for _ in range(count):
        now += rng.choice([1, 7, 900, 40_000, 300_000, 2_500_000])
        us.append(now)
    return np.array(us), np.array([rng.choice([1, 1, 2, 5, 30]) for _ in us])


@pytest.mark.parametrize(
    "rule",
    [
        limiter.SlidingLog(1, 500_000),
        limiter.SlidingLog(3, 1_000_000),
        limiter.SlidingLog(40, 5_000_000),
        limiter.SlidingLog(0, 1_000_000),
        limiter.TokenBucket(1.0, 3),
        limiter.TokenBucket(0.37, 5),
        limiter.TokenBucket(40.0, 2),
    ],
)
def test_walk_equals_single_decisions(rule):
    rng = random.Random(11)
    us, n = _stretches(rng, 4000)
    taken, before = np.zeros(len(us), "int64"), np.zeros(len(us))
    state, at = rule.start(), 0
    while at < len(us):  # batches cut the run anywhere
        to = min(len(us), at + rng.choice([1, 3, 50, 900]))
        rule.walk(state, us[at:to], n[at:to], taken[at:to], before[at:to])
        at = to
    state = rule.start()
    for i in range(len(us)):
        for turn in range(1, int(n[i]) + 1):
            ok, left = rule.decide(state, int(us[i]))
            assert ok == (turn <= taken[i]), (i, turn)
            assert left == before[i] - min(turn, taken[i]), (i, turn)


def _calls(spark):
    rng = random.Random(5)
    base, rows, now = dt.datetime(2024, 1, 1), [], 0
    for i in range(1500):  # one key holds most calls, some instants many; event ids repeat and may be null
        now += rng.choice([0, 0, 0, 1, 90_000, 400_000])
        key = rng.choice(["hot"] * 8 + [None, "b"])
        rows.append((key, None if i % 97 == 0 else i // 2, None if i % 301 == 0 else base + dt.timedelta(microseconds=now)))
    return spark.createDataFrame(rows, "k string, id long, ts timestamp_ntz")


@pytest.mark.parametrize("limit,window", [(1, 1.0), (4, 2.0)])
def test_sliding_log_long_runs(spark, monkeypatch, limit, window):
    calls = _calls(spark)
    plain = limiter.sliding_log(calls, "k", "id", "ts", limit, window).collect()
    monkeypatch.setattr(limiter, "LONG_RUN", 20)
    walked = limiter.sliding_log(calls, "k", "id", "ts", limit, window).collect()
    assert sorted(map(str, walked)) == sorted(map(str, plain)) and len(walked) == 1500


@pytest.mark.parametrize("per_minute,burst", [(60.0, 3), (400.0, 6)])
def test_token_bucket_long_runs(spark, monkeypatch, per_minute, burst):
    calls = _calls(spark)
    plain = limiter.token_bucket(calls, "k", "id", "ts", per_minute, burst).collect()
    monkeypatch.setattr(limiter, "LONG_RUN", 20)
    walked = limiter.token_bucket(calls, "k", "id", "ts", per_minute, burst).collect()
    assert sorted(map(str, walked)) == sorted(map(str, plain)) and len(walked) == 1500


def test_cached_requests_of_one_busy_key(spark, monkeypatch):
    """A request every second for an hour, a time to live of 60 s: one in 60 is computed."""
    monkeypatch.setattr(limiter, "LONG_RUN", 100)
    calls = spark.range(3600).selectExpr("'q' AS k", "id", "timestamp_seconds(1700000000 + id) AS ts")
    got = limiter.cached_requests(calls, "k", "id", "ts", 60.0).filter("computed").collect()
    assert sorted(r["event"] for r in got) == list(range(0, 3600, 60))
