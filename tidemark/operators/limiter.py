"""Rate limits replayed over an event table.

Whether a call is allowed depends on earlier decisions, so calls are folded in time order. A key's
calls need not stay in one piece: time is cut into cells as long as the limiter's memory, counts per
(key, cell) are combined on the map side, and a new run starts wherever the state is known without
looking further back. Runs are the unit of distribution; inside a run rows stream through with a state
of at most ``limit`` instants, never a whole group in memory.

A run of more than ``LONG_RUN`` calls, such as a key that is busy without a pause, is not streamed row by
row. Its calls are counted per instant on the map side; one task walks the instants, skips those that cannot
be served with a binary search, and says how many calls each instant lets through. The calls themselves stay
spread over all tasks and take their instant's decision by an equi join that splits hot instants.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage, travels

travels(__name__)

MICROS = 1_000_000
LONG_RUN = 5_000_000  # calls, some ten seconds of one task; only the way of computing changes beyond it


def _micros(df: DataFrame, ts: str):
    c = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        c = c.cast("timestamp")
    return F.unix_micros(c)


def _prepare(events: DataFrame, key: str, event: str, ts: str, cell_micros: int) -> DataFrame:
    us = _micros(events, ts)
    return events.select(
        F.col(key).alias("key"), F.col(event).alias("event"), us.alias("us"), F.floor(us / F.lit(cell_micros)).cast("bigint").alias("cell")
    )


def _runs(rows: DataFrame, calm_limit: int | None) -> DataFrame:
    """``(key, cell, run, long, feeds, feeds_long)``: a run starts after an empty cell, or after a calm one.

    A cell is calm when it and the cell before hold no more calls than the limit: all its calls are
    allowed whatever came before, and they are the whole state for the next cell.
    """
    cells = rows.filter("us IS NOT NULL").groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key").orderBy("cell")
    adjacent = F.lag("cell").over(w) == F.col("cell") - 1
    prev = F.when(adjacent, F.lag("n").over(w)).otherwise(0)
    cells = cells.withColumn("prev", F.coalesce(prev, F.lit(0)))
    calm = F.lit(False) if calm_limit is None else F.col("n") + F.col("prev") <= calm_limit
    cells = cells.withColumn("calm", calm)
    after_calm = F.coalesce(F.lag("calm").over(w), F.lit(False))
    start = F.when((F.col("prev") == 0) | after_calm, F.col("cell"))
    run = F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the calm cell before a run start belongs to the new run too, as its history
    feeds = F.when(F.col("calm") & (F.lead("cell").over(w) == F.col("cell") + 1), F.col("cell") + 1)
    cells = cells.select("key", "cell", "n", run.alias("run"), feeds.alias("feeds"))
    cells = cells.withColumn("long", F.sum("n").over(Window.partitionBy("key", "run")) > LONG_RUN)
    return cells.select("key", "cell", "run", "long", "feeds", F.coalesce(F.lead("long").over(w), F.lit(False)).alias("feeds_long"))


def _fold(rows: DataFrame, runs: DataFrame, limiter: Limiter, out_schema: str) -> DataFrame:
    """Decide the rows of each run in the order of instant and event.

    Null is a key like any other; rows without an instant come back undecided.
    """
    timed, untimed = rows.filter("us IS NOT NULL"), rows.filter("us IS NULL")
    runs = cut_lineage(runs)  # a row per key and cell
    any_long = runs.filter("long").limit(1).count() > 0
    r = runs.withColumnsRenamed({"key": "__key", "cell": "__cell"})
    placed = timed.join(r, F.col("key").eqNullSafe(F.col("__key")) & (F.col("cell") == F.col("__cell")))
    own = F.struct(F.col("run"), F.lit(False).alias("warm"), F.col("long"))
    history = F.struct(F.col("feeds").alias("run"), F.lit(True).alias("warm"), F.col("feeds_long").alias("long"))
    uses = F.when(F.col("feeds").isNull(), F.array(own)).otherwise(F.array(own, history))
    both = placed.select("key", "event", "us", F.inline(uses))
    both = both.withColumn("place", F.xxhash64("key", "run"))  # a null key compares unequal to itself in Python
    out = _replayed(both.filter("NOT long") if any_long else both, limiter, out_schema)
    if any_long:
        out = out.unionByName(_walked(both.filter("long"), limiter, out_schema))
    nothing = untimed.select("key", "event", F.lit(None).cast("boolean").alias("allowed"), F.lit(None).alias("remaining"))
    return out.unionByName(nothing)


def _replayed(rows: DataFrame, limiter: Limiter, out_schema: str) -> DataFrame:
    """Runs streamed row by row."""
    ordered = rows.repartition("place").sortWithinPartitions("place", "us", "event")

    def replay(batches):
        current, state = None, None
        for pdf in batches:
            allowed, left, keep = [], [], []
            for place, us, warm in zip(pdf["place"].tolist(), pdf["us"].tolist(), pdf["warm"].tolist()):
                if place != current:
                    current, state = place, limiter.start()
                ok, remaining = limiter.decide(state, us)
                allowed.append(ok)
                left.append(remaining)
                keep.append(not warm)
            out = pd.DataFrame({"key": pdf["key"], "event": pdf["event"], "allowed": allowed, "remaining": left})
            yield out[pd.Series(keep, index=out.index)]

    return ordered.mapInPandas(replay, out_schema)


def _walked(rows: DataFrame, limiter: Limiter, out_schema: str) -> DataFrame:
    """Long runs: instants walked in order, their calls decided where they lie.

    ``taken`` calls of an instant are allowed, the first by event; ``before`` is what was left when the instant came. The last
    allowed event of an instant splits its calls, so only allowed rows and copies of that event are ever ranked.
    """
    at = ["place", "us"]
    instants = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).repartition("place").sortWithinPartitions(*at)

    def walk(batches):
        current, state = None, None
        for pdf in batches:
            place, us, n = (pdf[c].to_numpy() for c in ("place", "us", "n"))
            taken, before = np.zeros(len(pdf), "int64"), np.zeros(len(pdf), "float64")
            borders = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(pdf)]
            for a, b in zip(borders, borders[1:]):
                if a == b:
                    continue
                if place[a] != current:
                    current, state = place[a], limiter.start()
                limiter.walk(state, us[a:b], n[a:b], taken[a:b], before[a:b])
            yield pd.DataFrame({"place": place, "us": us, "taken": taken, "before": before})

    decided = instants.mapInPandas(walk, "place bigint, us bigint, taken bigint, before double")
    calls = rows.filter("NOT warm").select("key", F.struct("event").alias("e"), *at)  # structs compare nulls first, as the order does
    calls = cut_lineage(calls.join(decided, at))
    by_event = Window.partitionBy(*at).orderBy("e")
    served = calls.filter("taken > 0").withColumn("turn", F.row_number().over(by_event))
    served = cut_lineage(served.filter(F.col("turn") <= limiter.most).filter("turn <= taken"))  # the constant bound is applied before the shuffle
    edge = served.groupBy(*at).agg(F.max("e").alias("edge"), F.count(F.lit(1)).alias("served"))
    level = served.join(edge.select(*at, "edge"), at).filter("e = edge").groupBy(*at).agg(F.count(F.lit(1)).alias("level"))
    rest = calls.join(edge.join(level, at), at, "left")
    copies = rest.filter("e = edge").withColumn("turn", F.row_number().over(by_event)).filter("turn > level").drop("turn")
    refused = rest.filter("edge IS NULL OR e > edge").unionByName(copies)

    def result(part, allowed, left):
        remaining = (F.col("before") - left).cast(out_schema.rsplit(" ", 1)[1])
        return part.select("key", F.col("e.event").alias("event"), F.lit(allowed).alias("allowed"), remaining.alias("remaining"))

    return result(served, True, F.col("turn")).unionByName(result(refused, False, F.col("taken")))


def _schema(rows: DataFrame, remaining: str) -> str:
    t = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return f"key {t['key']}, event {t['event']}, allowed boolean, remaining {remaining}"


class Limiter:
    """State of one run: ``decide`` takes one call, ``walk`` a stretch of distinct instants with ``n`` calls each.

    ``most`` bounds the calls that one instant lets through.
    """

    most: int

    def start(self):
        raise NotImplementedError

    def decide(self, state, us):
        raise NotImplementedError

    def walk(self, state, us, n, taken, before):
        raise NotImplementedError


class SlidingLog(Limiter):
    def __init__(self, limit: int, width: int):
        self.limit, self.width, self.most = limit, width, max(0, limit)

    def start(self):
        return deque()

    def decide(self, state, us):
        while state and state[0] <= us - self.width:
            state.popleft()
        ok = len(state) < self.limit
        if ok:
            state.append(us)
        return ok, max(0, self.limit - len(state))

    def walk(self, state, us, n, taken, before):
        """A full log serves nothing until its oldest call leaves the window, so all instants up to then are passed over."""
        i = 0
        while i < len(us):
            now = int(us[i])
            while state and state[0] <= now - self.width:
                state.popleft()
            free = self.most - len(state)
            if free > 0:
                taken[i], before[i] = min(int(n[i]), free), free
                state.extend([now] * int(taken[i]))
                i += 1
            elif not state:  # a limit of zero
                return
            else:
                i += int(np.searchsorted(us[i:], state[0] + self.width))


class TokenBucket(Limiter):
    def __init__(self, rate: float, burst: int):
        self.rate, self.burst, self.most = rate, float(burst), max(0, int(burst))

    def start(self):
        return [self.burst, None]

    def decide(self, state, us):
        if state[1] is not None:
            state[0] = min(self.burst, state[0] + (us - state[1]) / 1e6 * self.rate)
        state[1] = us
        ok = state[0] >= 1
        if ok:
            state[0] -= 1
        return ok, state[0]

    def walk(self, state, us, n, taken, before):
        """Below one token the refills are added up in order, in stretches that double, until one is reached."""
        last = int(us[0]) if state[1] is None else state[1]
        refill = np.diff(us, prepend=last) / 1e6 * self.rate
        i, stretch = 0, 64
        while i < len(us):
            if state[0] < 1:
                sums = np.minimum(self.burst, np.add.accumulate(np.concatenate(([state[0]], refill[i : i + stretch])))[1:])
                reached = np.flatnonzero(sums >= 1)
                stop = int(reached[0]) if len(reached) else len(sums)
                before[i : i + stop] = sums[:stop]
                if stop:
                    state[0] = float(sums[stop - 1])
                i += stop
                stretch = 64 if len(reached) else min(2 * stretch, 1 << 16)
                if not len(reached):
                    continue
            state[0] = min(self.burst, state[0] + float(refill[i]))
            before[i] = state[0]
            taken[i] = min(int(n[i]), int(state[0]))
            state[0] -= int(taken[i])
            i += 1
        state[1] = int(us[-1])


def sliding_log(events: DataFrame, key: str, event: str, ts: str, limit: int, window_seconds: float) -> DataFrame:
    """``(key, event, allowed, remaining)``: allowed while fewer than ``limit`` allowed calls lie in the window.

    Rejected calls do not count. ``remaining`` is what is left after the call.
    """
    width = int(round(window_seconds * MICROS))
    rows = _prepare(events, key, event, ts, width)
    return _fold(rows, _runs(rows, limit), SlidingLog(limit, width), _schema(rows, "int"))


def token_bucket(events: DataFrame, key: str, event: str, ts: str, per_minute: float, burst: int) -> DataFrame:
    """``(key, event, allowed, remaining)``: refill ``per_minute / 60`` tokens a second up to ``burst``, one per call.

    An idle cell as long as a full refill leaves a full bucket, so the next call starts a new run.
    """
    rate = per_minute / 60.0
    width = int(round(burst / rate * MICROS)) + 1
    rows = _prepare(events, key, event, ts, width)
    return _fold(rows, _runs(rows, None), TokenBucket(rate, burst), _schema(rows, "double"))


def cached_requests(requests: DataFrame, key: str, event: str, ts: str, ttl_seconds: float = 1800.0) -> DataFrame:
    """``(key, event, computed)``: a request is computed when no stored answer younger than the TTL exists.

    A stored answer counts from the request that computed it, which is the sliding log with a limit of one.
    """
    return sliding_log(requests, key, event, ts, 1, ttl_seconds).select("key", "event", F.col("allowed").alias("computed"))
