"""Structured Streaming forms of the metric, validation, reuse, limit and scoring operators."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.stages import Stage
from tidemark.operators.validate import Validation
from tidemark.session import scratch_path, travels

travels(__name__)

BUCKETS = 2048  # groups that the keys of a state machine are dealt to by hash; fixed, as a restarted stream must find its states
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(
    spark: SparkSession, path: str, schema, ts: str | None = None, files_per_trigger: int | None = None, bytes_per_trigger: int = 1 << 30
) -> DataFrame:
    """Parquet files as a stream; a zone-less instant column becomes a timestamp so that it can carry a watermark.

    A micro-batch is bounded by bytes (or by files), so a backlog is worked off in pieces.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    df = reader.parquet(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if ts else df


def run_available(stream: DataFrame, name: str, state: str | None = None, mode: str = "append") -> DataFrame:
    """Work off all input there is now into a table in the shared folder and return that table."""
    spark = stream.sparkSession
    base = state or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def windowed_metrics(stream: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Run metrics per window and key; rows later than the watermark are dropped."""
    ok = F.count_if(F.col("status") == "completed")
    total = F.count(F.lit(1))
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *keys)
        .agg(
            total.alias("total"),
            ok.alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.sum("execution_time_ms").alias("time_ms"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *keys,
            "total",
            "completed",
            "failed",
            (F.col("completed") * 100 / F.col("total")).alias("success_rate"),
            (F.coalesce("time_ms", F.lit(0.0)) / F.col("total")).alias("avg_time"),
        )
    )


def run_windows(stream: DataFrame, name: str, ts: str, keys: list[str], size: str, slide: str | None = None) -> DataFrame:
    """Run metrics of all windows of all input there is now, whatever its order and however it is cut into micro-batches.

    Every micro-batch leaves its partial counts and sums, which are added when read: no row is late, open windows come too.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)

    def partial(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(window.alias("window"), *keys).agg(
            F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"), F.sum("execution_time_ms").alias("time_ms"),
        ).write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

    partial(spark.createDataFrame([], stream.schema), -1)
    stream.writeStream.foreachBatch(partial).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(f"{base}/rows")
    rows = parts.groupBy("window", *keys).agg(*[F.sum(c).alias(c) for c in ("total", "completed", "failed", "time_ms")])
    return rows.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "total", "completed", "failed",
        (F.col("completed") * 100 / F.col("total")).alias("success_rate"),
        (F.coalesce("time_ms", F.lit(0.0)) / F.col("total")).alias("avg_time"),
    )


def checked(stream: DataFrame, rules: Validation) -> DataFrame:
    """Every row with the rules it breaks; filter on ``broken_rules`` for the accepted and the rejected stream."""
    broken = F.filter(F.array(*[F.when(r.bad, F.lit(r.name)) for r in rules.rules]), lambda x: x.isNotNull())
    return stream.withColumn("broken_rules", F.array_join(broken, ","))


def split_sink(accepted: str, rejected: str):
    """``foreachBatch`` target that appends good and bad rows to two tables, replacing a batch that is replayed."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        batch.filter("broken_rules = ''").drop("broken_rules").write.mode("overwrite").parquet(f"{accepted}/epoch={epoch}")
        batch.filter("broken_rules <> ''").write.mode("overwrite").parquet(f"{rejected}/epoch={epoch}")
        batch.unpersist()

    return write


def run_split(stream: DataFrame, rules: Validation, base: str) -> tuple[DataFrame, DataFrame]:
    """Validate all available rows into an accepted and a rejected table."""
    spark = stream.sparkSession
    query = (
        checked(stream, rules)
        .writeStream.foreachBatch(split_sink(f"{base}/accepted", f"{base}/rejected"))
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/accepted"), spark.read.parquet(f"{base}/rejected")


def scored(stream: DataFrame, stage: Stage, expression: Column, name: str = "score") -> DataFrame:
    """Replay a fitted stage on the stream and add a score column."""
    return stage.transform(stream).withColumn(name, expression)


class Limiter(StatefulProcessor):
    """A state machine a key. The keys of a bucket keep their states in one list, which a micro-batch reads and writes once.

    A state is ``[us, event_id, ...]``: the last call and what the limiter remembers (``MEMORY``).
    """

    MEMORY: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", f"key string, us long, event_id long, {self.MEMORY}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The rows of one micro-batch (whose size the trigger bounds), those of each key in time order."""
        batch = pd.concat(list(rows))
        code = pd.factorize(batch["key"], use_na_sentinel=False)[0]
        batch = batch.iloc[np.lexsort((batch["event_id"], batch["us"], code))]
        states = {r[0]: list(r[1:]) for r in self.kept.get()} if self.kept.exists() else {}
        names = [k if isinstance(k, str) else None for k in batch["key"].tolist()]
        allowed, late = [], []
        for name, us, event in zip(names, batch["us"].tolist(), batch["event_id"].tolist()):
            state = states.get(name)
            if state is None:
                state = states[name] = self.start()
            late.append(state[0] is not None and (us, event) < (state[0], state[1]))
            allowed.append(None if late[-1] else self.decide(state, us))
            if not late[-1]:
                state[0], state[1] = int(us), int(event)
        self.kept.put([(name, *state) for name, state in states.items()])
        yield pd.DataFrame({"key": names, "event_id": batch["event_id"].to_numpy(), "us": batch["us"].to_numpy(), "allowed": pd.Series(allowed, dtype=object), "late": late})

    def close(self) -> None:
        pass


class SlidingLog(Limiter):
    """Allowed while fewer than ``limit`` allowed calls lie in the window; a key remembers those instants."""

    MEMORY = "log array<long>"

    def __init__(self, limit: int, window_micros: int):
        self.limit, self.width = limit, window_micros

    def start(self) -> list:
        return [None, None, []]

    def decide(self, state: list, us: int) -> bool:
        log = state[2]
        gone = bisect_right(log, us - self.width)
        if gone:
            log = state[2] = log[gone:]
        ok = len(log) < self.limit
        if ok:
            log.append(int(us))
        return ok


class TokenBucket(Limiter):
    """Refill by rate up to the burst, one token per call; a key remembers its level."""

    MEMORY = "tokens double"

    def __init__(self, per_minute: float, burst: int):
        self.rate, self.burst = per_minute / 60.0, float(burst)

    def start(self) -> list:
        return [None, None, self.burst]

    def decide(self, state: list, us: int) -> bool:
        tokens = state[2]
        if state[0] is not None:
            tokens = min(self.burst, tokens + (us - state[0]) / 1e6 * self.rate)
        ok = tokens >= 1
        state[2] = float(tokens - (1 if ok else 0))
        return ok


def limited(stream: DataFrame, ts: str, processor: StatefulProcessor, key: str = "user_id", event: str = "event_id") -> DataFrame:
    """``(key, event_id, us, allowed, late)`` by a keyed state machine.

    Keys are handed to it in ``BUCKETS`` groups, since a call, its frames and its state cost milliseconds however little they hold.
    A row older than what its key has already seen in an earlier micro-batch comes back as late and undecided, so every
    input row comes back; ``settled`` decides it.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(event).cast("bigint").alias("event_id"), F.unix_micros(ts).alias("us"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType="key string, event_id long, us long, allowed boolean, late boolean",
        outputMode="Append",
        timeMode="None",
    )


def settled(rows: DataFrame, decide) -> DataFrame:
    """``(key, event_id, allowed)`` as if all rows had come in time order: keys with late rows are replayed whole.

    ``decide`` maps ``(key, event_id, ts)`` rows to ``(key, event, allowed)``, as the batch limiters do.
    """
    broken = rows.filter("late").select(F.col("key").alias("__key")).distinct()
    same = F.col("key").eqNullSafe(F.col("__key"))
    again = decide(rows.join(broken, same, "left_semi").select("key", "event_id", F.timestamp_micros("us").alias("ts")))
    return rows.join(broken, same, "left_anti").select("key", "event_id", "allowed").unionByName(again.select("key", F.col("event").alias("event_id"), "allowed"))


def with_rocksdb(spark: SparkSession):
    """Context that selects the state store keyed state machines need, and restores the setting after."""
    from contextlib import contextmanager

    @contextmanager
    def setting():
        name = "spark.sql.streaming.stateStore.providerClass"
        old = spark.conf.get(name, None)
        spark.conf.set(name, ROCKSDB)
        try:
            yield
        finally:
            spark.conf.set(name, old) if old else spark.conf.unset(name)

    return setting()
