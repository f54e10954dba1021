"""Filter, page, join and mutation queries."""

from pyspark.sql import functions as F

from tidemark.functions import geojson
from tidemark.operators import relational as rel
from tidemark.plans.registry import query

AS_OF = "2024-01-20 12:00:00"


@query(
    "filter_lookup",
    "P1 P2 P4 P5 P6 P11 P18 J14",
    """SELECT id, name, location_type, country_key FROM locations
    WHERE NOT is_deleted AND location_type IN ('city', 'poi') AND country_key = 7 AND id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
    ("locations",),
)
def filter_lookup(t):
    """Live locations of two types in one country that have a finished order; private columns left out."""
    hits = rel.filter_by(rel.live(t.locations), country_key=7).filter(F.col("location_type").isin("city", "poi"))
    keys = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return rel.by_keys(hits, keys, "id").select("id", "name", "location_type", "country_key")


@query("exists_batch", "P2", "SELECT o_custkey + 700 AS id, (o_custkey + 700) IN (SELECT c_custkey FROM customer) AS present FROM orders")
def exists_batch(t):
    """For each shifted order customer whether such a customer exists."""
    keys = t.orders.select((F.col("o_custkey") + 700).alias("id"))
    return rel.exists(t.customer.withColumnRenamed("c_custkey", "id"), keys, "id")


@query("search_ilike", "P3", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET%' ORDER BY p_partkey LIMIT 100")
def search_ilike(t):
    """First hundred parts whose name holds a text, any case."""
    return rel.search_text(t.part, "WIDGET", ["p_name"], "p_partkey").select("p_partkey", "p_name")


@query(
    "time_window",
    "P7",
    """SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 36 HOUR GROUP BY user_id""",
)
def time_window(t):
    """Events per user not older than 36 hours before a given instant."""
    return rel.since(t.events, "ts", AS_OF, "'36' HOUR").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "bounding_box",
    "P8",
    "SELECT id, latitude, longitude FROM locations WHERE latitude BETWEEN -40 AND 10 AND (longitude >= 150 OR longitude <= -150)",
    ("locations",),
)
def bounding_box(t):
    """Locations in a box across the antimeridian."""
    return t.locations.filter(rel.in_box("latitude", "longitude", -40.0, 150.0, 10.0, -150.0)).select("id", "latitude", "longitude")


@query(
    "page_ordered",
    "T1 T7 P10",
    """SELECT id, name, status, created_seq FROM models WHERE status = 'production' ORDER BY created_seq, id LIMIT 50 OFFSET 100""",
    ("models",),
)
def page_ordered(t):
    """Third page of production models by age."""
    rows = rel.page(rel.filter_by(t.models, status="production"), [F.asc("created_seq"), F.asc("id")], 50, 100)
    return rows.select("id", "name", "status", "created_seq")


@query(
    "page_history",
    "T2",
    """WITH r AS (SELECT id, agent_type, status, created_at FROM agent_executions WHERE agent_type = 'ml')
    SELECT *, (SELECT count(*) FROM r) AS total, 90 < (SELECT count(*) FROM r) AS has_more FROM r ORDER BY created_at DESC, id LIMIT 30 OFFSET 60""",
    ("agent_executions",),
)
def page_history(t):
    """Newest-first page of one agent's runs with total and has_more."""
    runs = rel.filter_by(t.agent_executions, agent_type="ml").select("id", "agent_type", "status", "created_at")
    return rel.history_page(runs, "created_at", "id", 30, 60)


def _merge_inputs(t):
    orders = t.orders.select(
        F.expr("CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE o_custkey END").alias("custkey"),
        F.col("o_orderkey").alias("ref"),
        F.col("o_totalprice").alias("amount"),
    )
    cust = t.customer.select(
        F.expr("CASE WHEN c_custkey = 0 THEN NULL ELSE c_custkey + 100 END").alias("custkey"),
        F.col("c_nationkey").alias("ref"),
        F.col("c_acctbal").alias("balance"),
    )
    return orders, cust


_MERGE_CTES = """WITH l AS (SELECT CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE o_custkey END AS custkey, o_orderkey AS ref, o_totalprice AS amount FROM orders),
  r AS (SELECT CASE WHEN c_custkey = 0 THEN NULL ELSE c_custkey + 100 END AS custkey, c_nationkey AS ref, c_acctbal AS balance FROM customer)"""


def _merge_sql(how, key):
    return f"{_MERGE_CTES} SELECT {key} AS custkey, l.ref AS ref_x, l.amount, r.ref AS ref_y, r.balance FROM l {how} JOIN r ON l.custkey IS NOT DISTINCT FROM r.custkey"


@query("merge_inner", "J1", _merge_sql("INNER", "l.custkey"))
def merge_inner(t):
    """Orders with customers, null keys matching each other."""
    return rel.merge(*_merge_inputs(t), ["custkey"], "inner")


@query("merge_left", "J1", _merge_sql("LEFT", "l.custkey"))
def merge_left(t):
    """All orders with their customers."""
    return rel.merge(*_merge_inputs(t), ["custkey"], "left")


@query("merge_right", "J1", _merge_sql("RIGHT", "r.custkey"))
def merge_right(t):
    """All customers with their orders."""
    return rel.merge(*_merge_inputs(t), ["custkey"], "right")


@query("merge_outer", "J1", _merge_sql("FULL", "CASE WHEN l.ref IS NULL THEN r.custkey ELSE l.custkey END"))
def merge_outer(t):
    """Orders and customers, both sides kept."""
    return rel.merge(*_merge_inputs(t), ["custkey"], "outer")


@query(
    "merge_report",
    "J1",
    f"""{_MERGE_CTES} SELECT n.merged_rows, n.input_rows, greatest(0, n.input_rows - n.merged_rows) AS unmatched_rows FROM (
      SELECT (SELECT count(*) FROM l JOIN r ON l.custkey IS NOT DISTINCT FROM r.custkey JOIN r r2 ON l.custkey IS NOT DISTINCT FROM r2.custkey) AS merged_rows,
        (SELECT count(*) FROM l) + 2 * (SELECT count(*) FROM r) AS input_rows) n""",
)
def merge_report(t):
    """Row accounting of a left-deep three-way merge."""
    orders, cust = _merge_inputs(t)
    third = cust.select("custkey", F.col("balance").alias("limit_amount"))
    return rel.merge_report([orders, cust, third], ["custkey"])


@query(
    "fk_counts",
    "J2 A31 A1",
    """SELECT p.model_id, m.name, count(*) AS predictions, count(DISTINCT p.user_id) AS users, CAST(sum(CASE WHEN c.c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS orphans
    FROM predictions p JOIN models m ON p.model_id = m.id LEFT JOIN customer c ON p.user_id = c.c_custkey GROUP BY p.model_id, m.name""",
    ("predictions", "models"),
)
def fk_counts(t):
    """Predictions per model through the foreign keys to model and user."""
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    models = t.models.select(F.col("id").alias("model_id"), "name")
    per_user = t.predictions.groupBy("model_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_user.join(users, "user_id", "left")
        .groupBy("model_id")
        .agg(
            F.sum("n").alias("predictions"),
            F.count_if(F.col("user_id").isNotNull()).alias("users"),
            F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("orphans"),
        )
        .join(models, "model_id")
    )


@query(
    "cascade_delete",
    "J3",
    "SELECT p.id, p.model_id FROM predictions p WHERE p.model_id NOT IN (SELECT id FROM models WHERE status = 'archived')",
    ("predictions", "models"),
)
def cascade_delete(t):
    """Predictions left after their archived models are removed."""
    return rel.cascade_delete(t.predictions, rel.filter_by(t.models, status="archived"), "model_id", "id").select("id", "model_id")


@query(
    "insert_absent",
    "S12 J14",
    """SELECT DISTINCT doc_id, length(text) AS n FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def insert_absent(t):
    """Documents with text that the label table does not hold yet."""
    return rel.insert_absent(t.labels, t.documents, "doc_id", "text").select("doc_id", F.length("text").cast("bigint").alias("n"))


@query(
    "execution_tree",
    "J15",
    """SELECT p.id, p.agent_type, p.status, count(c.id) AS children, count(*) FILTER (WHERE c.status = 'completed') AS completed,
      count(*) FILTER (WHERE c.status = 'failed') AS failed FROM agent_executions p LEFT JOIN agent_executions c ON c.parent_execution_id = p.id
    GROUP BY p.id, p.agent_type, p.status""",
    ("agent_executions",),
)
def execution_tree(t):
    """Every run with the state counts of its children."""
    return rel.execution_tree(t.agent_executions)


def _updates(t):
    return rel.filter_by(t.locations, location_type="city").select(
        "id",
        (F.col("latitude") + 1).alias("latitude"),
        F.expr("CASE WHEN latitude > 0 THEN concat(name, '!') END").alias("name"),
        F.lit(1).alias("not_a_column"),
    )


@query(
    "keyed_update",
    "D1",
    "SELECT id, CASE WHEN location_type = 'city' THEN latitude + 1 ELSE latitude END AS latitude, CASE WHEN location_type <> 'city' THEN name WHEN latitude > 0 THEN name || '!' END AS name FROM locations",
    ("locations",),
)
def keyed_update(t):
    """Update of two fields by key; an unknown field is ignored."""
    return rel.update_by_key(t.locations, _updates(t), "id").select("id", "latitude", "name")


@query(
    "update_keep_nulls",
    "D2 D7",
    "SELECT id, name, CASE WHEN location_type = 'poi' THEN TRUE ELSE is_deleted END AS is_deleted FROM locations",
    ("locations",),
)
def update_keep_nulls(t):
    """Flag change in which null fields of the update keep the stored value."""
    new = rel.filter_by(t.locations, location_type="poi").select("id", F.lit(None).cast("string").alias("name"), F.lit(True).alias("is_deleted"))
    return rel.update_by_key(t.locations, new, "id", keep_on_null=True).select("id", "name", "is_deleted")


@query("update_count", "D1", "SELECT count(*) AS matched FROM locations WHERE location_type = 'city'", ("locations",))
def update_count(t):
    """How many rows a keyed update touches."""
    return rel.matched_count(t.locations, _updates(t), "id")


@query(
    "delete_keys",
    "D3",
    """SELECT id, name, is_deleted, 'hard' AS mode FROM locations WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT id, name, is_deleted OR id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'), 'soft' FROM locations""",
    ("locations",),
)
def delete_keys(t):
    """Hard and soft delete of the customers with a pending order."""
    keys = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    df = t.locations.select("id", "name", "is_deleted")
    hard = rel.delete_by_key(df, keys, "id").withColumn("mode", F.lit("hard"))
    return hard.unionByName(rel.delete_by_key(df, keys, "id", soft=True).withColumn("mode", F.lit("soft")))


@query(
    "retention",
    "D4",
    """SELECT count(*) FILTER (WHERE created_at >= TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 90 DAY) AS kept,
      count(*) FILTER (WHERE created_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 90 DAY) AS deleted FROM predictions""",
    ("predictions",),
)
def retention(t):
    """Predictions kept and dropped under a 90 day retention."""
    kept = rel.retain(t.predictions, "created_at", "1998-06-01 00:00:00", 90).agg(F.count(F.lit(1)).alias("kept"))
    total = t.predictions.agg(F.count(F.lit(1))).scalar()
    return kept.withColumn("deleted", total - F.col("kept"))


@query(
    "model_status",
    "D5 P5",
    """SELECT id, CASE WHEN version > 40 THEN 'production' ELSE status END AS status,
      CASE WHEN version > 40 THEN TIMESTAMP '2024-02-01 00:00:00' END AS deployed_at FROM models""",
    ("models",),
)
def model_status(t):
    """Deploy every model above a version; the deploy instant is stamped."""
    models = t.models.withColumn("deployed_at", F.lit(None).cast("timestamp_ntz"))
    out = rel.set_status(models, models.filter("version > 40"), "production", "2024-02-01 00:00:00")
    return out.select("id", "status", "deployed_at")


@query(
    "feedback_writeback",
    "D6 A33",
    """WITH f AS (SELECT doc_id AS id, quality * 4 + toxic AS score FROM labels),
      p AS (SELECT p.id, p.model_id, CASE WHEN f.score BETWEEN 1 AND 5 THEN f.score END AS score, p.predicted_value = p.actual_value AS is_correct
        FROM predictions p LEFT JOIN f ON p.id = f.id)
    SELECT model_id, count(score) AS rated, round(avg(score), 6) AS avg_score, round(avg(CASE WHEN is_correct THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy
    FROM p GROUP BY model_id""",
    ("predictions",),
)
def feedback_writeback(t):
    """Write valid 1..5 scores back to predictions, then mean score and accuracy per model."""
    scores = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") * 4 + F.col("toxic")).alias("score")).filter("score BETWEEN 1 AND 5")
    base = t.predictions.withColumn("score", F.lit(None).cast("int"))
    out = rel.update_by_key(base, scores, "id")
    return out.groupBy("model_id").agg(
        F.count("score").alias("rated"),
        F.round(F.avg("score"), 6).alias("avg_score"),
        F.round(F.avg((F.col("predicted_value") == F.col("actual_value")).cast("double")), 6).alias("accuracy"),
    )


@query(
    "latest_model",
    "W1 L19",
    """SELECT name, id, version, created_seq FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_seq DESC, id DESC) AS rn
      FROM models WHERE status = 'production') WHERE rn = 1""",
    ("models",),
)
def latest_model(t):
    """Newest production model per name."""
    return rel.latest(t.models, ["name"], ["created_seq", "id"]).select("name", "id", "version", "created_seq")


@query(
    "agent_metrics",
    "A3",
    """SELECT coalesce(agent_type, 'all') AS agent_type, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
      count(*) FILTER (WHERE status = 'failed') AS failed, round(count(*) FILTER (WHERE status = 'completed') * 100.0::DOUBLE / count(*), 2) AS success_rate,
      round(sum(execution_time_ms) / count(*), 2) AS avg_time
    FROM agent_executions WHERE created_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR GROUP BY ROLLUP (agent_type)""",
    ("agent_executions",),
)
def agent_metrics(t):
    """Day metrics per agent and over all agents."""
    return rel.agent_metrics(t.agent_executions, AS_OF, 24, rollup=True)


@query(
    "system_stats",
    "A2 P6",
    """SELECT 'locations' AS metric, count(*) AS value FROM locations WHERE NOT is_deleted UNION ALL SELECT 'predictions', count(*) FROM predictions
    UNION ALL SELECT 'models', count(*) FROM models UNION ALL SELECT 'active_runs', count(*) FROM agent_executions WHERE status IN ('pending', 'running')""",
    ("locations", "predictions", "models", "agent_executions"),
)
def system_stats(t):
    """Counts of live locations, predictions, models and unfinished runs."""
    return rel.system_stats(
        {
            "locations": (t.locations, ~F.col("is_deleted")),
            "predictions": (t.predictions, None),
            "models": (t.models, None),
            "active_runs": (t.agent_executions, F.col("status").isin("pending", "running")),
        }
    )


@query(
    "task_rollup",
    "A24 A23",
    """WITH r AS (SELECT user_id AS task_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events),
    a AS (SELECT task_id, count(*) AS total_agents, count(*) FILTER (WHERE status = 'success') AS successful_agents,
      count(*) FILTER (WHERE status = 'failed') AS failed_agents FROM r GROUP BY task_id)
    SELECT *, round(successful_agents::DOUBLE / total_agents, 6) AS success_rate, CASE WHEN failed_agents > 0
      THEN 'Task partially completed. ' || successful_agents || '/' || total_agents || ' agents succeeded. Review failed agents for issues.'
      ELSE 'Task completed successfully with ' || successful_agents || ' agents. All operations executed without errors.' END AS summary FROM a""",
)
def task_rollup(t):
    """Success roll-up and summary sentence per task."""
    results = t.events.select(F.col("user_id").alias("task_id"), F.expr("CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END").alias("status"))
    return rel.task_rollup(results).withColumn("success_rate", F.round("success_rate", 6))


@query(
    "batch_prediction_rollup",
    "A23",
    """SELECT model_id, count(*) AS total, count(*) FILTER (WHERE confidence >= 0.2) AS ok, count(*) FILTER (WHERE confidence < 0.2) AS failed,
      round(avg(confidence) FILTER (WHERE confidence >= 0.2), 6) AS avg_confidence FROM predictions GROUP BY model_id""",
    ("predictions",),
)
def batch_prediction_rollup(t):
    """Scored and rejected predictions per model."""
    ok = F.col("confidence") >= 0.2
    return t.predictions.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.round(F.avg(F.when(ok, F.col("confidence"))), 6).alias("avg_confidence"),
    )


@query(
    "feature_vector",
    "P13 P14 U2",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 10 = 0 THEN 'value' ELSE '' END AS missing_names,
      CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) + value END AS vector_sum FROM events""",
)
def feature_vector(t):
    """Ordered vectors from JSON features; rows lacking a feature are marked, not failed."""
    feats = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("double")).withColumn(
        "features",
        F.when(F.col("event_id") % 10 == 0, F.create_map(F.lit("k"), F.col("k"))).otherwise(
            F.create_map(F.lit("k"), F.col("k"), F.lit("value"), F.col("value"))
        ),
    )
    out = rel.feature_vector(feats, "features", ["k", "value"])
    return out.select(
        "event_id",
        "k",
        F.array_join("missing_features", ",").alias("missing_names"),
        F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("vector_sum"),
    )


@query("review_trigger", "P15", "SELECT event_id, value FROM events WHERE value / 20 > 4 OR (event_id % 97) / 500.0::DOUBLE < 0.05")
def review_trigger(t):
    """Rows that need a human look: severity above 4 or distance below 0.05."""
    return t.events.filter((F.col("value") / 20 > 4) | ((F.col("event_id") % 97) / F.lit(500.0) < 0.05)).select("event_id", "value")


@query(
    "drop_sparse",
    "P16 P17",
    "SELECT id, coalesce(note, '{}') AS note, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_iso FROM (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END AS note, ts AS created_at FROM events)",
)
def drop_sparse(t):
    """Columns over 30 % empty are dropped; nulls get defaults and instants the ISO form."""
    df = t.events.select(
        F.col("event_id").alias("id"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN value END").alias("half_empty"),
        F.expr("CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END").alias("note"),
        F.col("ts").alias("created_at"),
    )
    out = rel.drop_sparse_columns(df)
    return out.withColumn("note", F.coalesce("note", F.lit("{}"))).withColumn("created_iso", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")).drop("created_at")


_FEATURE = """'{"type":"Feature","geometry":{"type":"Point","coordinates":[' || longitude || ',' || latitude || ']},"properties":{"id":' || id || ',"name":"' || name || '","location_type":"' || location_type || '"}}'"""


@query("geojson_features", "P12", f"SELECT id, {_FEATURE} AS feature FROM locations WHERE NOT is_deleted", ("locations",))
def geojson_features(t):
    """Each live location as a GeoJSON feature text."""
    return rel.live(t.locations).select("id", F.to_json(geojson.feature(["id", "name", "location_type"])).alias("feature"))


@query(
    "geojson_collection",
    "A30",
    f"""SELECT '{{"type":"FeatureCollection","features":[' || string_agg(feature, ',' ORDER BY id) || '],"count":' || count(*) || ',"limit":100,"offset":30}}' AS collection
    FROM (SELECT id, {_FEATURE} AS feature FROM locations WHERE NOT is_deleted ORDER BY id LIMIT 100 OFFSET 30)""",
    ("locations",),
)
def geojson_collection(t):
    """One page of locations as a feature collection."""
    return geojson.collection(rel.live(t.locations), ["id", "name", "location_type"], "id", 100, 30)


@query(
    "named_view",
    "P19",
    "SELECT label, count(*) AS n FROM (SELECT vec_id AS node_id, label FROM embeddings) GROUP BY label",
)
def named_view(t):
    """A named view over the node vectors, queried in SQL."""
    t.embeddings.select(F.col("vec_id").alias("node_id"), "label").createOrReplaceTempView("graph_node_embeddings")
    return t.spark.sql("SELECT label, count(*) AS n FROM graph_node_embeddings GROUP BY label")
