"""File format, catalog and streaming queries."""

from pyspark.sql import functions as F

from tidemark.operators import limiter, stages, validate
from tidemark.plans.registry import query
from tidemark.plans.sky_text import _SEQ, _log_sql
from tidemark.session import scratch_path
from tidemark.sources import files
from tidemark.streaming import operators as st

_PART_SQL = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"


def _roundtrip(t, suffix, schema=None):
    df = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = scratch_path(t.spark, "parts") + suffix
    files.write_table(df.repartition(3), path)
    back = files.read_table(t.spark, path, schema)
    return back.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_brand", F.col("p_size").cast("int").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice")
    )


@query("io_csv", "S1 S7 S8", _PART_SQL)
def io_csv(t):
    """Parts written and read as CSV with inferred types."""
    return _roundtrip(t, ".csv")


@query("io_tsv", "S2 S7 S8", _PART_SQL)
def io_tsv(t):
    """Parts written and read as TSV with a given schema."""
    return _roundtrip(t, ".tsv", "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double")


@query("io_parquet", "S3 S7 S8", _PART_SQL)
def io_parquet(t):
    """Parts written and read as Parquet."""
    return _roundtrip(t, ".parquet")


@query("io_json", "S4 S7 S8", _PART_SQL)
def io_json(t):
    """Parts written and read as JSON arrays."""
    return _roundtrip(t, ".json")


@query("io_jsonl", "S5 S7 S8", _PART_SQL)
def io_jsonl(t):
    """Parts written and read as JSON lines."""
    return _roundtrip(t, ".jsonl")


@query("io_feather", "S6 S7 S8", _PART_SQL)
def io_feather(t):
    """Parts written and read as Arrow files."""
    return _roundtrip(t, ".feather")


@query(
    "dataset_info",
    "S9",
    "SELECT 'parquet' AS format, CAST(1 AS BIGINT) AS files, TRUE AS has_bytes, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS columns, 'bigint,string,string,string,int,double' AS dtypes FROM (SELECT count(*) AS n FROM part) WHERE n > 0",
)
def dataset_info(t):
    """Format, files, size, columns and types of the parts table from its listing."""
    info = files.dataset_info(t.spark, f"{t.sf_dir}/part.parquet")
    return info.select("format", "files", (F.col("bytes") > 0).alias("has_bytes"), F.array_join("columns", ",").alias("columns"), F.array_join("dtypes", ",").alias("dtypes"))


@query(
    "ingest_report",
    "S10",
    """SELECT count(*) AS rows, CAST(4 AS INTEGER) AS columns, 's_suppkey:bigint,s_name:string,s_nationkey:int,s_acctbal:double' AS dtypes, CAST(3 AS INTEGER) AS preview_rows FROM supplier""",
)
def ingest_report(t):
    """Counts, types and preview of the suppliers."""
    r = files.ingest_report(t.supplier)
    return r.select("rows", "columns", F.array_join("dtypes", ",").alias("dtypes"), F.size("preview").alias("preview_rows"))


@query(
    "bulk_append",
    "S11",
    """SELECT 'stored' AS state, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT 'rejected', count(*), round(sum(c_acctbal), 2) FROM customer WHERE c_acctbal < 0""",
)
def bulk_append(t):
    """Two appends with a rule; broken rows are not stored."""
    path = scratch_path(t.spark, "customers") + ".parquet"
    low, high = t.customer.filter("c_nationkey < 12"), t.customer.filter("c_nationkey >= 12")
    bad = F.col("c_acctbal") < 0
    rejected = files.append_checked(low, path, bad).unionByName(files.append_checked(high, path, bad))
    stored = files.read_table(t.spark, path).withColumn("state", F.lit("stored"))
    both = stored.unionByName(rejected.withColumn("state", F.lit("rejected")))
    return both.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query(
    "dataset_catalog",
    "S15 W1",
    """SELECT 'parts' AS name, 'second load' AS description, count(*) AS rows, '[{"column":"p_partkey","missing":0},{"column":"p_name","missing":0}]' AS stats FROM part""",
)
def dataset_catalog(t):
    """Latest catalog entry of a dataset registered twice."""
    df = t.part.select("p_partkey", "p_name")
    old = files.catalog_entry(df.filter("p_partkey % 2 = 0"), "parts", "local", "/data/parts", "2024-01-01 00:00:00", "first load")
    new = files.catalog_entry(df, "parts", "local", "/data/parts", "2024-02-01 00:00:00", "second load")
    return files.latest_entries(old.unionByName(new)).select("name", "description", "rows", "stats")


@query(
    "partitioned_write",
    "S8 S13",
    "SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2",
)
def partitioned_write(t):
    """Events written by type; a read of two types touches their folders only."""
    path = scratch_path(t.spark, "events") + ".parquet"
    files.write_table(t.events.withColumn("day", F.to_date("ts")), path, partition_by=["event_type"])
    back = files.read_table(t.spark, path).filter(F.col("event_type").isin("click", "error"))
    return back.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


def _by_type(t, suffix):
    path = scratch_path(t.spark, "typed") + suffix
    files.write_table(t.events.select("event_id", "event_type", (F.col("user_id") % 8).cast("int").alias("shard")), path, partition_by=["event_type", "shard"])
    back = files.read_table(t.spark, path)
    return back.groupBy("event_type", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").cast("bigint").alias("ids"))


_TYPED_SQL = "SELECT event_type, CAST(user_id % 8 AS INTEGER) AS shard, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2"


@query("partitioned_arrow", "S6 S8", _TYPED_SQL)
def partitioned_arrow(t):
    """Events written as Arrow files by type and shard of users, read back with the folders as columns."""
    return _by_type(t, ".feather")


@query("partitioned_json", "S4 S8", _TYPED_SQL)
def partitioned_json(t):
    """The same as JSON arrays, one or more whole arrays in each folder."""
    return _by_type(t, ".json")


# --- streams --------------------------------------------------------------------------------------


def _event_stream(t):
    return st.read_stream(t.spark, f"{t.sf_dir}/event[s].parquet", t.events.schema, ts="ts")


def _run_stream(t):
    status = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'pending' ELSE 'completed' END"
    return _event_stream(t).select(
        "ts",
        F.expr("CASE user_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'ml' ELSE 'geo' END").alias("agent_type"),
        F.expr(status).alias("status"),
        F.expr("CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) END").alias("execution_time_ms"),
    )


def _window_sql(hours, slide):
    return f"""WITH w AS (SELECT *, unnest([{', '.join(f'time_bucket(INTERVAL {slide} HOUR, created_at) - INTERVAL {i * slide} HOUR' for i in range(hours // slide))}]) AS s FROM agent_executions)
    SELECT s AS window_start, s + INTERVAL {hours} HOUR AS window_end, agent_type, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
      count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'completed') * 100.0::DOUBLE / count(*) AS success_rate,
      coalesce(sum(floor(execution_time_ms)), 0) / count(*) AS avg_time
    FROM w GROUP BY s, agent_type"""


def _plain_windows(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_tumbling", "ST1 A3", _window_sql(6, 6), ("agent_executions",))
def stream_tumbling(t):
    """Run metrics per six-hour window from a stream."""
    return _plain_windows(st.run_windows(_run_stream(t), "tumbling", "ts", ["agent_type"], "6 hours"))


@query("stream_sliding", "ST1 A3", _window_sql(12, 6), ("agent_executions",))
def stream_sliding(t):
    """Run metrics per twelve-hour window sliding by six, from a stream."""
    return _plain_windows(st.run_windows(_run_stream(t), "sliding", "ts", ["agent_type"], "12 hours", "6 hours"))


_PAIRS = "(SELECT CAST(user_id AS VARCHAR) || ':' || event_type AS user_id, event_id, ts FROM events) e"


@query("stream_dedup", "ST2 V3", _log_sql(1, 1800, "event_id, allowed AS computed").replace("FROM events", f"FROM {_PAIRS}"))
def stream_dedup(t):
    """Requests of one user and type: computed, or answered from an answer younger than half an hour."""
    requests = _event_stream(t).withColumn("request", F.concat_ws(":", "user_id", "event_type"))
    with st.with_rocksdb(t.spark):
        seen = st.run_available(st.limited(requests, "ts", st.SlidingLog(1, 1800 * limiter.MICROS), "request"), "dedup")
    out = st.settled(seen, lambda e: limiter.sliding_log(e, "key", "event_id", "ts", 1, 1800))
    return out.select("event_id", F.col("allowed").alias("computed"))


@query("stream_rate_limit", "ST3 W10", _log_sql(3, 36 * 3600, "user_id, event_id, allowed"))
def stream_rate_limit(t):
    """Sliding-log limiter as a keyed state machine on a stream."""
    with st.with_rocksdb(t.spark):
        seen = st.run_available(st.limited(_event_stream(t), "ts", st.SlidingLog(3, 36 * 3600 * limiter.MICROS)), "limit")
    out = st.settled(seen, lambda e: limiter.sliding_log(e, "key", "event_id", "ts", 3, 36 * 3600))
    return out.select(F.col("key").cast("bigint").alias("user_id"), "event_id", "allowed")


@query(
    "stream_token_bucket",
    "ST3 W11",
    f"""WITH RECURSIVE {_SEQ}, r AS (
      SELECT user_id, k, event_id, us, TRUE AS allowed, CAST(3 AS DOUBLE) AS tokens FROM s WHERE k = 1
      UNION ALL SELECT user_id, k, event_id, us, full_ >= 1, CASE WHEN full_ >= 1 THEN full_ - 1 ELSE full_ END
      FROM (SELECT s.user_id, s.k, s.event_id, s.us, least(CAST(4 AS DOUBLE), r.tokens + (s.us - r.us) / 1e6::DOUBLE * (0.001::DOUBLE / 60.0::DOUBLE)) AS full_ FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1))
    SELECT user_id, event_id, allowed FROM r""",
)
def stream_token_bucket(t):
    """Token-bucket limiter as a keyed state machine on a stream."""
    with st.with_rocksdb(t.spark):
        seen = st.run_available(st.limited(_event_stream(t), "ts", st.TokenBucket(0.001, 4)), "bucket")
    out = st.settled(seen, lambda e: limiter.token_bucket(e, "key", "event_id", "ts", 0.001, 4))
    return out.select(F.col("key").cast("bigint").alias("user_id"), "event_id", "allowed")


@query(
    "stream_validate",
    "ST4 A16 A17 F27",
    """SELECT event_id, concat_ws(',', CASE WHEN value < 1 THEN 'too_small' END, CASE WHEN NOT regexp_matches(event_type, '^[a-z]{4,6}$') THEN 'type_format' END) AS broken_rules,
      CASE WHEN value < 1 OR NOT regexp_matches(event_type, '^[a-z]{4,6}$') THEN 'rejected' ELSE 'accepted' END AS state FROM events""",
)
def stream_validate(t):
    """Accepted and rejected rows of a validated stream."""
    rules = validate.Validation().rule("too_small", "value", F.col("value") < 1).rule("type_format", "event_type", ~F.col("event_type").rlike("^[a-z]{4,6}$"))
    good, bad = st.run_split(_event_stream(t), rules, scratch_path(t.spark, "validated"))
    a = good.select("event_id", F.lit("").alias("broken_rules"), F.lit("accepted").alias("state"))
    return a.unionByName(bad.select("event_id", "broken_rules", F.lit("rejected").alias("state")))


@query(
    "stream_score",
    "ST5 M16",
    """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events WHERE ts < TIMESTAMP '2024-01-16'),
    d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT event_type AS v FROM events WHERE ts < TIMESTAMP '2024-01-16'))
    SELECT event_id, round(0.3 * (value - m) / d + 0.1 * i, 6) AS score FROM events, s JOIN d ON event_type = d.v""",
)
def stream_score(t):
    """A stage chain fitted on a table and replayed on the stream, then a linear score."""
    train = t.events.filter("ts < TIMESTAMP_NTZ '2024-01-16'").select("event_type", "value")
    chain = stages.Chain(stages.Scale("standard", ["value"]), stages.LabelEncode(["event_type"], unseen=-1)).fit(train)
    out = st.scored(_event_stream(t).select("event_id", "event_type", "value"), chain, F.round(0.3 * F.col("value") + 0.1 * F.col("event_type"), 6))
    return st.run_available(out.select("event_id", "score"), "scored")
