"""Relational, vector, text, file and streaming operators."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import astro, hashing, text, vectors
from tidemark.operators import graph, limiter, relational, vector
from tidemark.plans import registry
from tidemark.session import scratch_path
from tidemark.sources import files
from tidemark.streaming import operators as st


def test_merge_golden(people, bonus):
    assert relational.merge(people, bonus, ["id"]).count() == 4
    row = relational.merge_report([people, bonus], ["id"]).first()
    assert (row["merged_rows"], row["input_rows"], row["unmatched_rows"]) == (4, 8, 4)
    with pytest.raises(ValueError):
        relational.merge_all([people], ["id"])


def test_merge_null_keys_and_suffixes(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 10), (2, 20)], "k int, v int")
    assert sorted(map(tuple, relational.merge(a, b, ["k"]).collect())) == [(None, 1, 10)]
    outer = {(r["k"], r["v_x"], r["v_y"]) for r in relational.merge(a, b, ["k"], "outer").collect()}
    assert outer == {(None, 1, 10), (1, 2, None), (2, None, 20)}


def test_strict_filter(people):
    with pytest.raises(ValueError):
        relational.filter_by(people, nope=1)
    assert relational.filter_by(people, ignore_unknown=True, nope=1, id=1).count() == 2
    with pytest.raises(ValueError):
        relational.page(people, [F.asc("id")], limit=1001)


def test_updates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(1, None)], "id int, v string")
    assert dict(map(tuple, relational.update_by_key(df, new, "id").collect())) == {1: None, 2: "b"}
    assert dict(map(tuple, relational.update_by_key(df, new, "id", keep_on_null=True).collect())) == {1: "a", 2: "b"}


def test_topk_blocks_equal_one_block(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(80)] + [(80, [0.0] * 6)]
    corpus = spark.createDataFrame(data, "id long, embedding array<float>")
    queries = corpus.withColumnRenamed("id", "query_id")
    one = vector.topk_cosine(queries, corpus, 4, 0.2).collect()
    many = vector.topk_cosine(queries, corpus, 4, 0.2, block_values=60).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    m = np.array([v for _, v in data], dtype=np.float32).astype(float)
    for r in one:
        a, b = m[r["query_id"]], m[r["id"]]
        assert r["similarity"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-6)
    assert not [r for r in one if 80 in (r["query_id"], r["id"])]


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [None, 1.0]
    assert df.select(F.size(vectors.resize(F.col("a"), 1))).first()[0] == 1


def test_index_with_all_probes_is_exact(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    corpus = spark.createDataFrame(data, "id long, embedding array<float>")
    queries = corpus.limit(10).withColumnRenamed("id", "query_id")
    exact = sorted((r["query_id"], r["id"]) for r in vector.topk_cosine(queries, corpus, 3, 0.1).collect())
    probed = sorted((r["query_id"], r["id"]) for r in vector.CoarseIndex(corpus, lists=6).search(queries, 3, probes=6, min_similarity=0.1).collect())
    assert exact == probed


def test_lists_are_skipped_and_results_stay_exact(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 8)) * 4
    m = np.concatenate([middle[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.2, rng.normal(size=(60, 8)), np.zeros((2, 8))])
    m[100:400] = m[100]  # a third of all rows are one vector
    data = [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]
    corpus = spark.createDataFrame(data + [(5000, None)], "id long, embedding array<double>")
    queries = corpus.withColumnRenamed("id", "query_id")
    size = np.linalg.norm(m, axis=1)
    unit = m / np.where(size > 0, size, 1)[:, None]
    s = np.round(unit @ unit.T, 9)
    for k, floor in ((5, 0.3), (1, -1.0), (40, 0.9)):
        got = {}
        for r in vector.topk_cosine(queries, corpus, k, floor, 9, block_values=400, lists=20).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
        for i in range(960):
            best = sorted((-s[i, j], j) for j in range(960) if s[i, j] > floor)[:k]
            assert sorted(got.get(i, [])) == [(n + 1, j) for n, (_, j) in enumerate(best)], (k, i)
        assert set(got) <= set(range(960))
    centres = unit[:20]
    table = vector._listed(corpus.filter("id < 960"), centres)
    parts, angle = vector._sizes(table, 20, 8, 400)
    assert max(parts) >= 6 and sum(p > 0 for p in parts) > 5 and angle.max() > 0.1


def test_stored_index_reads_only_its_lists(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)] + [(300, [0.0] * 4), (301, None)]
    corpus = spark.createDataFrame(data, "id long, embedding array<float>")
    vector.CoarseIndex(corpus, lists=8, path=str(tmp_path / "index"))
    index = vector.CoarseIndex.open(spark, str(tmp_path / "index"))
    assert index.table.count() == 300 and len(index.parts) == len(index.centres) == 8
    one = spark.createDataFrame([(7, data[7][1])], "query_id long, embedding array<float>")
    out = index.search(one, 3, probes=1)
    assert out.first()["id"] == 7
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    few = vector.CoarseIndex(corpus.limit(0), lists=8)
    assert few.search(one).count() == 0 and vector.topk_cosine(one, corpus.limit(0)).count() == 0
    assert vector.topk_cosine(one.limit(0), corpus).count() == 0


def test_knn_far_from_zero(spark):
    df = spark.createDataFrame([(1, 1e9, None), (2, 1e9 + 3, 20.0), (3, 1e9 + 0.5, 10.0), (None, 1e9, None)], "id long, a double, b double")
    for block in (1, 10**6):
        got = sorted(tuple(r) for r in vector.knn_impute(df, "id", ["a", "b"], k=1, block_values=block).select("b", "a").collect())
        assert got == [(10.0, 1e9), (10.0, 1e9 + 0.5), (15.0, 1e9), (20.0, 1e9 + 3)]


def test_knn_blocks_and_hopeless_column(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 7), float(i % 5), None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    one = sorted(map(tuple, vector.knn_impute(df, "id", ["a", "b", "c"], k=3).collect()), key=lambda r: r[0])
    many = sorted(map(tuple, vector.knn_impute(df, "id", ["a", "b", "c"], k=3, block_values=100).collect()), key=lambda r: r[0])
    assert one == many and len(one) == 60
    assert all(r[1] is not None and r[3] is None for r in one)


def test_bfs_types_and_cycle(spark):
    edges = spark.createDataFrame([(1, 2, "A"), (2, 3, "A"), (3, 1, "A"), (1, 9, "B")], "source_id long, target_id long, edge_type string")
    seeds = spark.createDataFrame([(1,)], "node long")
    got = {(r["node"], r["hop"]) for r in graph.bfs(edges, seeds, 3, ["A"]).collect()}
    assert got == {(1, 0), (2, 1), (3, 2)}


def test_texts(spark):
    def run(expr):
        return spark.range(1).select(expr.alias("v")).first()["v"]

    assert run(text.domain(F.lit("Will the ASTEROID cause drought?"))) == "astronomy"
    assert run(text.domain(F.lit("drought"))) == "climate"
    assert run(text.domain(F.lit("hello"))) == "multi"
    assert run(text.agents(F.lit("html page"))) == ["ml"]
    assert run(text.agents(F.lit("nothing"))) == ["data"]
    subs = run(text.subtasks(F.lit("x"), F.array(F.lit("ml"), F.lit("geo"), F.lit("data"))))
    assert [s["agent"] for s in subs] == ["data", "ml", "geo"]
    empty = F.create_map().cast("map<string,double>")
    assert run(text.attribution_sentence(text.top_attributions(empty, 3))) == "No feature attribution available."
    assert run(text.percent0(F.lit(0.125))) == "12%"
    said = run(text.answer(F.lit("climate"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(3.44), text.top_attributions(empty, 3), F.lit(0)))
    assert said == "Drought assessment: normal — severity score 3.4/5.0 (confidence: 0%)."


def test_hashes(spark):
    df = spark.createDataFrame([("x", 1)], "b string, a int")
    got = df.select(hashing.evidence_hash({"b": F.col("b"), "a": F.col("a")}), hashing.cache_key("ns", {"a": F.col("a")})).first()
    assert got[0] == hashlib.sha256(json.dumps({"a": 1, "b": "x"}, separators=(",", ":")).encode()).hexdigest()
    assert got[1] == "ns:" + hashlib.md5(b'{"a":1}').hexdigest()


def test_astronomy_golden(spark):
    def run(expr):
        return spark.range(1).select(expr.alias("v")).first()["v"]

    assert run(astro.distance_units(F.lit(4.37))["distance_parsecs"]) == 1.3398
    far = astro.parallax(F.lit(100.0))
    assert (run(far["distance_parsecs"]), run(far["distance_light_years"])) == (10.0, 32.62)
    assert run(astro.parallax(F.lit(0.0))["distance_parsecs"]) is None
    m = astro.absolute_magnitude(F.lit(1.0), F.lit(10.0))
    assert run(m) == 1.0 and run(astro.luminosity_ratio(m)) == pytest.approx(34.0408, abs=1e-4)
    o = astro.orbit(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    assert (run(o["period_days"]), run(o["circular_velocity_km_s"])) == (365.25, 29.78)
    there = astro.rotate(F.lit(266.405), F.lit(-28.936), "icrs", "galactic")
    assert run(there["lat"]) == pytest.approx(0.0, abs=0.01)
    back = astro.rotate(F.lit(run(there["lon"])), F.lit(run(there["lat"])), "galactic", "icrs")
    assert (run(back["lon"]), run(back["lat"])) == (pytest.approx(266.405), pytest.approx(-28.936))


def test_file_dispatch(spark, people):
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, "/tmp/no/such/place.csv")
    with pytest.raises(ValueError, match="supported"):
        files.read_table(spark, "/tmp/table.xyz")
    for suffix in (".csv", ".tsv", ".parquet", ".json", ".jsonl", ".feather"):
        path = scratch_path(spark, "people") + suffix
        files.write_table(people, path)
        back = files.read_table(spark, path)
        assert sorted(r["name"] for r in back.collect()) == ["Alice", "Alice", "Bob", "Charlie", "David"], suffix
        assert back.filter("salary IS NULL").count() == 1, suffix
        info = files.dataset_info(spark, path).first()
        assert info["files"] >= 1 and info["bytes"] > 0


def test_csv_keeps_line_breaks(spark):
    df = spark.createDataFrame([(1, 'a "quoted"\nline, two')], "id int, t string")
    path = scratch_path(spark, "breaks") + ".csv"
    files.write_table(df, path)
    assert files.read_table(spark, path, multiLine=True).first()["t"] == 'a "quoted"\nline, two'


def test_stream_replays_equal_batch(spark):
    """Several micro-batches in time order give the batch answer; state carries over between them."""
    from test_ordered import calls, frame, replay_log

    rows = [(i, 1 if k == "hot" else 2, t) for i, k, t in calls(5, 300)]
    df = frame(spark, [(i, str(k), t) for i, k, t in rows]).select(F.col("k").cast("long").alias("user_id"), F.col("id").alias("event_id"), "ts")
    base = scratch_path(spark, "feed")
    for part in range(3):
        df.filter(F.col("event_id").between(part * 100, part * 100 + 99)).coalesce(1).write.mode("append").parquet(base)
    stream = st.read_stream(spark, base, df.schema, "ts", files_per_trigger=1)
    with st.with_rocksdb(spark):
        out = st.run_available(st.limited(stream, "ts", st.SlidingLog(3, 2_000_000)), "replay")
    got = {r["event_id"]: r["allowed"] for r in out.collect()}
    want = {i: ok for i, (ok, _) in replay_log(rows, 3, 2_000_000).items()}
    assert got == want


def test_stream_keys_share_calls_and_states(spark, monkeypatch):
    """Many keys, one of them null, pass a state machine in few calls, over several micro-batches, with the batch answer."""
    import datetime as dt

    class Counting(st.SlidingLog):
        def handleInputRows(self, key, rows, timerValues):
            for out in super().handleInputRows(key, rows, timerValues):
                yield out.assign(us=out["key"].nunique(dropna=False))

    monkeypatch.setattr(st, "BUCKETS", 2, raising=False)
    start = dt.datetime(2024, 1, 1)
    rows = [(None if i % 30 == 0 else i % 30, i, start + dt.timedelta(minutes=7 * i)) for i in range(360)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    base = scratch_path(spark, "keys")
    for part in range(3):
        df.filter(F.col("event_id").between(part * 120, part * 120 + 119)).coalesce(1).write.mode("append").parquet(base)
    stream = lambda: st.read_stream(spark, base, df.schema, "ts", files_per_trigger=1)
    with st.with_rocksdb(spark):
        seen = st.run_available(st.limited(stream(), "ts", st.SlidingLog(2, 8 * 3_600_000_000)), "shared")
        together = st.run_available(st.limited(stream(), "ts", Counting(2, 8 * 3_600_000_000)), "counted")
    out = st.settled(seen, lambda e: limiter.sliding_log(e, "key", "event_id", "ts", 2, 8 * 3600))
    want = limiter.sliding_log(df, "user_id", "event_id", "ts", 2, 8 * 3600)
    assert {(r["event_id"], r["allowed"]) for r in out.collect()} == {(r["event"], r["allowed"]) for r in want.collect()}
    assert together.count() == 360 and together.agg(F.min("us")).first()[0] > 5


def test_late_rows_are_dropped(spark):
    import datetime as dt

    def batch(hours, path):
        rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), "a", "completed", 1.0) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    schema = "ts timestamp, agent_type string, status string, execution_time_ms double"
    path = scratch_path(spark, "late")
    # the watermark that decides on lateness is that of the batch before
    for hours in ([0, 1], [30], [31], [0, 50]):
        batch(hours, path)
    stream = st.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    out = st.run_available(st.windowed_metrics(stream, "ts", ["agent_type"], "6 hours"), "lates")
    first = [r["total"] for r in out.collect() if r["window_start"] == dt.datetime(2024, 1, 1)]
    assert first == [2]


def test_registry_refuses_a_second_name():
    import __spark_entry__  # noqa: F401  loads all queries

    with pytest.raises(ValueError):
        registry.query("validate_report", "A8")(lambda t: None)


def test_pages_by_key_and_box(spark):
    df = spark.range(50).withColumnRenamed("id", "id")
    first = [r["id"] for r in relational.page_after(df, "id", None, 20).collect()]
    second = [r["id"] for r in relational.page_after(df, "id", first[-1], 20).collect()]
    assert first + second == list(range(40))
    with pytest.raises(ValueError):
        relational.in_box("latitude", "longitude", 10.0, 0.0, -10.0, 5.0)
    pts = spark.createDataFrame([(0.0, 179.0), (0.0, -179.0), (0.0, 0.0)], "latitude double, longitude double")
    assert pts.filter(relational.in_box("latitude", "longitude", -1.0, 178.0, 1.0, -178.0)).count() == 2


def test_search_wildcards_and_missing_fields(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, "ALP"), (3, "beta")], "id int, name string")
    assert [r["id"] for r in relational.search_text(df, "a_h").collect()] == []
    assert [r["id"] for r in relational.search_text(df, "l_h").collect()] == [1]
    assert [r["id"] for r in relational.search_text(df, "alp").collect()] == [1, 2]
    assert relational.search_text(df, "x", ["nope"]).count() == 0


def test_task_rollup_and_metrics_on_nothing(spark):
    runs = spark.createDataFrame([], "agent_type string, status string, execution_time_ms double, created_at timestamp_ntz")
    assert relational.agent_metrics(runs, "2024-01-01 00:00:00").count() == 0
    done = spark.createDataFrame([(1, "success"), (1, "failed"), (2, "success")], "task_id int, status string")
    rows = {r["task_id"]: r for r in relational.task_rollup(done).collect()}
    assert rows[1]["success_rate"] == 0.5 and rows[1]["summary"].startswith("Task partially completed. 1/2")
    assert rows[2]["summary"] == "Task completed successfully with 1 agents. All operations executed without errors."


def test_unsupported_model_type():
    from tidemark.operators import training

    with pytest.raises(ValueError, match="unknown model type"):
        training.estimator("oracle")


def test_latest_keeps_one_row_of_a_hot_key(spark):
    df = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 7) END AS name", "id AS created_seq", "'production' AS status")
    got = {r["name"]: r["created_seq"] for r in relational.latest(df, ["name"], ["created_seq"]).collect()}
    assert got["hot"] == 1998 and len(got) == 8


def test_feature_vectors_and_rejects(spark):
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, {"a": 1.0}), (3, None)], "id int, f map<string,double>")
    rows = {r["id"]: r for r in relational.feature_vector(df, "f", ["b", "a"]).collect()}
    assert rows[1]["vector"] == [2.0, 1.0]
    assert rows[2]["missing_features"] == ["b"] and rows[2]["vector"] is None
    assert sorted(rows[3]["missing_features"]) == ["a", "b"]
