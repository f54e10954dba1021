"""Vector search, graph and monitoring queries."""

from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.operators import graph, monitor, vector
from tidemark.plans.registry import query

_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query(
    "vector_similarity",
    "F23 F24",
    f"""SELECT a.vec_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS similarity, CAST(80 AS INTEGER) AS padded,
      round(CAST(a.embedding[3] AS DOUBLE), 6) AS third FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def vector_similarity(t):
    """Cosine similarity of each vector to the next one, and the padded form."""
    a = t.embeddings.select("vec_id", "embedding")
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    padded = vectors.resize(F.col("embedding"), 80)
    return a.join(b, "vec_id").select(
        "vec_id",
        F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"),
        F.size(padded).alias("padded"),
        F.round(F.element_at(padded, 3).cast("double"), 6).alias("third"),
    )


def _search_inputs(t):
    corpus = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), corpus


@query(
    "vector_topk",
    "V1 T3",
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS.format(a='a.embedding', b='b.embedding')}, 9) AS similarity FROM embeddings a, embeddings b),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn FROM s WHERE similarity > 0.3)
    SELECT query_id, id, round(similarity, 6) AS similarity, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 5""",
)
def vector_topk(t):
    """Five most similar vectors of every vector, above a similarity of 0.3."""
    out = vector.topk_cosine(*_search_inputs(t), k=5, min_similarity=0.3, digits=9)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("vector_ivf", "V2")
def vector_ivf(t):
    """Approximate search through coarse lists (seeded clustering, so without SQL)."""
    queries, corpus = _search_inputs(t)
    return vector.CoarseIndex(corpus, lists=20).search(queries, k=5, probes=6)


@query(
    "vector_ivf_recall",
    "V2",
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS.format(a='a.embedding', b='b.embedding')}, 9) AS similarity FROM embeddings a, embeddings b),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn FROM s WHERE similarity > 0.3)
    SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, CAST(count(*) FILTER (query_id = id) AS BIGINT) AS themselves, count(*) > 0 AS reached FROM r WHERE rn <= 5""",
)
def vector_ivf_recall(t):
    """Whether the stored lists give at least nine in ten of the exact neighbours, with the exact ones counted."""
    queries, corpus = _search_inputs(t)
    index = vector.CoarseIndex.open(t.spark, vector.CoarseIndex(corpus, lists=20).path)
    found = index.search(queries, k=5, probes=12, digits=9).select("query_id", "id", F.lit(1).alias("hit"))
    both = vector.topk_cosine(queries, corpus, k=5, min_similarity=0.3, digits=9).join(found, ["query_id", "id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"),
        F.count_if(F.col("query_id") == F.col("id")).alias("themselves"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("reached"),
    )


@query(
    "knn_impute_far",
    "M10",
    """WITH d AS (SELECT p_partkey AS id, 1e9 + p_retailprice / 10 AS a, CASE WHEN p_partkey % 8 = 3 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS b FROM part),
    p AS (SELECT q.id AS qid, v.b, row_number() OVER (PARTITION BY q.id ORDER BY sqrt(round(pow(q.a - v.a, 2), 9) * 2), v.id) AS rn
      FROM d q JOIN d v ON q.id <> v.id WHERE q.b IS NULL AND v.b IS NOT NULL)
    SELECT id, round(coalesce(d.b, avg(p.b)), 4) AS b FROM d LEFT JOIN p ON qid = id AND rn <= 3 GROUP BY id, d.b""",
)
def knn_impute_far(t):
    """Gaps filled from the three nearest parts, whose values lie close together and far from zero."""
    df = t.part.select(
        F.col("p_partkey").alias("id"), (F.lit(1e9) + F.col("p_retailprice") / 10).alias("a"),
        F.when(F.col("p_partkey") % 8 != 3, F.col("p_size").cast("double")).alias("b"),
    )
    return vector.knn_impute(df, "id", ["a", "b"], k=3).select("id", F.round("b", 4).alias("b"))


@query(
    "knn_impute",
    "M10",
    """WITH d AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 8 = 3 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS a, CASE WHEN p_partkey % 11 = 4 THEN NULL ELSE p_retailprice / 10 END AS b,
      CAST(p_partkey * 31 % 97 AS DOUBLE) AS c FROM part),
    w AS (SELECT *, CAST(a IS NOT NULL AS INT) AS ka, CAST(b IS NOT NULL AS INT) AS kb FROM d),
    p AS (SELECT q.id AS qid, v.id AS vid, v.a AS va, v.b AS vb,
        sqrt(round(coalesce(pow(q.a - v.a, 2), 0) + coalesce(pow(q.b - v.b, 2), 0) + pow(q.c - v.c, 2), 9) * 3 / (q.ka * v.ka + q.kb * v.kb + 1)) AS dist
      FROM w q JOIN w v ON q.id <> v.id WHERE q.a IS NULL OR q.b IS NULL),
    ra AS (SELECT qid, avg(va) AS f FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vid) AS rn FROM p WHERE va IS NOT NULL) WHERE rn <= 5 GROUP BY qid),
    rb AS (SELECT qid, avg(vb) AS f FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vid) AS rn FROM p WHERE vb IS NOT NULL) WHERE rn <= 5 GROUP BY qid)
    SELECT id, round(coalesce(a, ra.f), 4) AS a, round(coalesce(b, rb.f), 4) AS b FROM d LEFT JOIN ra ON ra.qid = id LEFT JOIN rb ON rb.qid = id""",
)
def knn_impute(t):
    """Gaps of two columns filled from the five nearest parts."""
    k = F.col("p_partkey")
    df = t.part.select(
        k.alias("id"),
        F.when(k % 8 != 3, F.col("p_size").cast("double")).alias("a"),
        F.when(k % 11 != 4, F.col("p_retailprice") / 10).alias("b"),
        ((k * 31) % 97).cast("double").alias("c"),
    )
    out = vector.knn_impute(df, "id", ["a", "b", "c"], k=5)
    return out.select("id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(
    "bfs_3hop",
    "G1 J14",
    """WITH RECURSIVE st AS (SELECT DISTINCT source_id, target_id FROM graph_edges),
    r AS (SELECT vec_id AS seed, vec_id AS node, 0 AS hop FROM embeddings WHERE label = 3
      UNION SELECT r.seed, st.target_id, r.hop + 1 FROM r JOIN st ON st.source_id = r.node WHERE r.hop < 3)
    SELECT seed, node, min(hop) AS hop FROM r GROUP BY seed, node""",
    ("graph_edges",),
)
def bfs_3hop(t):
    """Nodes within three hops of every node of one label."""
    seeds = t.embeddings.filter("label = 3").select(F.col("vec_id").alias("node"))
    return graph.bfs(t.graph_edges, seeds, 3)


@query(
    "graph_neighbours",
    "G3",
    """WITH n AS (SELECT source_id AS node, target_id AS neighbour, 'out' AS direction, edge_type FROM graph_edges
      UNION ALL SELECT target_id, source_id, 'in', edge_type FROM graph_edges),
    d AS (SELECT node, count(*) FILTER (WHERE direction = 'out') AS out_degree, count(*) FILTER (WHERE direction = 'in') AS in_degree FROM n GROUP BY node)
    SELECT n.node, neighbour, direction, edge_type, out_degree, in_degree FROM n JOIN d ON n.node = d.node WHERE n.node IN (SELECT vec_id FROM embeddings WHERE label < 5)""",
    ("graph_edges",),
)
def graph_neighbours(t):
    """Neighbours of the nodes of some labels with the degrees of the node."""
    wanted = t.embeddings.filter("label < 5").select(F.col("vec_id").alias("node"))
    return graph.neighbours(t.graph_edges, wanted).join(graph.degrees(t.graph_edges), "node")


@query(
    "edges_confirmed",
    "G2 J9",
    """SELECT id AS source_id, user_id AS target_id, 'CONFIRMED_BY' AS edge_type FROM predictions WHERE predicted_value = actual_value AND confidence >= 0.1""",
    ("predictions",),
)
def edges_confirmed(t):
    """CONFIRMED_BY edges of correct predictions that are not stored yet."""
    rows = t.predictions.withColumnRenamed("user_id", "outcome_id")
    stored = rows.filter("confidence < 0.1").select(F.col("id").alias("source_id"), F.col("outcome_id").alias("target_id"), F.lit("CONFIRMED_BY").alias("edge_type"))
    return graph.confirmed_by(rows, stored)


@query(
    "edges_precede",
    "J10",
    """SELECT a.event_id AS source_id, b.event_id AS target_id, 'PRECEDES' AS edge_type, round((epoch_us(b.ts) - epoch_us(a.ts)) / 86400000000.0::DOUBLE, 6) AS gap_days
    FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR""",
)
def edges_precede(t):
    """PRECEDES edges to every later event of the same user within half a day."""
    return graph.precedes(t.events, "user_id", "ts", "event_id", 0.5).withColumn("gap_days", F.round("gap_days", 6))


TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "edges_correlate",
    "J12 A6",
    "WITH d AS (SELECT CAST(ts AS DATE) AS day, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS {e}, coalesce(sum(value) FILTER (WHERE event_type = '{e}'), 0) AS v_{e}" for e in TYPES)
    + " FROM events GROUP BY 1) "
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{a}' AS source_id, '{b}' AS target_id, 'CORRELATES_WITH' AS edge_type, round(corr({a}, {b}), 6) AS r FROM d) WHERE abs(r) > 0.5"
        for i, a in enumerate([x for e in TYPES for x in (e, f"v_{e}")])
        for b in [x for e in TYPES for x in (e, f"v_{e}")][i + 1 :]
    ),
)
def edges_correlate(t):
    """CORRELATES_WITH edges between daily counts and sums of the event types."""
    names = {}
    for e in TYPES:
        hit = F.col("event_type") == e
        names[e] = F.count_if(hit)
        names[f"v_{e}"] = F.coalesce(F.sum(F.when(hit, F.col("value"))), F.lit(0.0))
    return graph.correlates_with(t.events, names, F.to_date("ts")).withColumn("r", F.round("r", 6))


# --- monitoring -----------------------------------------------------------------------------------

_SCORED = "SELECT l.doc_id, l.quality AS label, CAST(d.n_chars > 900 AS INTEGER) AS prediction, (d.n_chars % 1000) / 1000.0::DOUBLE AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _scored(t):
    return t.labels.join(t.documents, "doc_id").select(
        "doc_id",
        F.col("quality").alias("label"),
        (F.col("n_chars") > 900).cast("int").alias("prediction"),
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"),
    )


@query(
    "confusion_matrix",
    "A20",
    f"SELECT label, prediction, count(*) AS n FROM ({_SCORED}) GROUP BY label, prediction",
)
def confusion_matrix(t):
    """Counts of label and prediction."""
    return monitor.confusion(_scored(t), "label", "prediction")


@query(
    "confusion_metrics",
    "A20",
    f"""WITH s AS ({_SCORED}), c AS (SELECT label AS k, count(*) AS sup, count(*) FILTER (WHERE label = prediction) AS tp FROM s GROUP BY label),
    p AS (SELECT prediction AS k, count(*) AS pred FROM s GROUP BY prediction),
    m AS (SELECT sup, tp, coalesce(tp::DOUBLE / pred, 0) AS pr, tp::DOUBLE / sup AS re FROM c LEFT JOIN p USING (k))
    SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(pr * sup) / sum(sup), 6) AS "precision", round(sum(re * sup) / sum(sup), 6) AS recall,
      round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * sup) / sum(sup), 6) AS f1, CAST(sum(sup) AS BIGINT) AS n FROM m""",
)
def confusion_metrics(t):
    """Accuracy and weighted precision, recall and F1."""
    out = monitor.classification_metrics(_scored(t), "label", "prediction")
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(
    "auc_logloss",
    "A20 A21",
    f"""WITH s AS ({_SCORED}), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM s),
    u AS (SELECT sum(rk) FILTER (WHERE label = 1) AS w, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM r),
    l AS (SELECT avg(-CASE WHEN label = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, score))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, score))) END) AS ll,
      avg(CASE WHEN CAST(score >= 0.5 AS INTEGER) = label THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM s)
    SELECT round((w - p * (p + 1) / 2) / (p::DOUBLE * n), 6) AS auc, round(ll, 6) AS log_loss, round(acc, 6) AS accuracy FROM u, l""",
)
def auc_logloss(t):
    """Rank-based AUC, log loss and threshold accuracy of a score."""
    s = _scored(t)
    loss = monitor.log_loss(s, "label", "score")
    return loss.select(
        F.round(monitor.auc(s, "label", "score").scalar(), 6).alias("auc"), F.round("log_loss", 6).alias("log_loss"), F.round("accuracy", 6).alias("accuracy")
    )


@query(
    "regression_error",
    "A22",
    "SELECT round(avg(abs(o_totalprice - (o_orderkey % 5000) * 60)), 4) AS mae, round(sqrt(avg(pow(o_totalprice - (o_orderkey % 5000) * 60, 2))), 4) AS rmse FROM orders",
)
def regression_error(t):
    """Mean absolute and root mean square error of a crude price guess."""
    df = t.orders.withColumn("guess", (F.col("o_orderkey") % 5000) * F.lit(60.0))
    return monitor.regression_metrics(df, "o_totalprice", "guess").select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query(
    "model_accuracy",
    "L14 J9",
    "SELECT model_id, count(*) AS n, round(avg(CASE WHEN predicted_value = actual_value THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM predictions GROUP BY model_id",
    ("predictions",),
)
def model_accuracy(t):
    """Accuracy per model from joined outcomes."""
    p = t.predictions
    scored = monitor.outcomes(p.drop("actual_value"), p.select("id", "actual_value"))
    return monitor.accuracy_by(scored, ["model_id"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "rolling_accuracy",
    "W5",
    """WITH d AS (SELECT model_id, CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE predicted_value = actual_value) AS ok FROM predictions GROUP BY 1, 2)
    SELECT model_id, day, CAST(sum(n) OVER w AS BIGINT) AS n, round(sum(ok) OVER w / sum(n) OVER w, 6) AS accuracy, sum(ok) OVER w / sum(n) OVER w < 0.85 AS retrain
    FROM d WINDOW w AS (PARTITION BY model_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""",
    ("predictions",),
)
def rolling_accuracy(t):
    """Seven-day accuracy per model with the retrain flag."""
    scored = t.predictions.withColumn("was_correct", F.col("predicted_value").eqNullSafe(F.col("actual_value")))
    return monitor.rolling_accuracy(scored, ["model_id"], "created_at").withColumn("accuracy", F.round("accuracy", 6))


def _psi_sql():
    cols = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice"}
    parts = []
    for c in cols:
        edges = ", ".join(f"{i / 10}" for i in range(1, 10))
        parts.append(
            f"""SELECT '{c}' AS feature, 'psi' AS kind, sum((greatest(coalesce(q, 0), 1e-6) - greatest(coalesce(p, 0), 1e-6)) * ln(greatest(coalesce(q, 0), 1e-6) / greatest(coalesce(p, 0), 1e-6))) AS shift
      FROM (SELECT bin, max(s) FILTER (WHERE side = 0) AS p, max(s) FILTER (WHERE side = 1) AS q FROM (
        SELECT side, bin, count(*) / sum(count(*)) OVER (PARTITION BY side) AS s FROM (
          SELECT side, len(list_filter(e, lambda x: v > x)) AS bin FROM (SELECT side, {c} AS v FROM x), (SELECT list_distinct(quantile_cont({c}, [{edges}])) AS e FROM x WHERE side = 0)) GROUP BY side, bin) GROUP BY bin)"""
        )
    tv = """SELECT 'l_returnflag', 'total_variation', sum(abs(p - q)) / 2 FROM (
      SELECT l_returnflag, count(*) FILTER (WHERE side = 0) / (SELECT count(*)::DOUBLE FROM x WHERE side = 0) AS p, count(*) FILTER (WHERE side = 1) / (SELECT count(*)::DOUBLE FROM x WHERE side = 1) AS q FROM x GROUP BY 1)"""
    return (
        """WITH x AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS side, l_returnflag,
        CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN l_quantity ELSE l_quantity * 1.3 END AS l_quantity, l_extendedprice FROM lineitem)
      SELECT feature, kind, round(shift, 6) AS shift, shift > 0.1 AS drifted FROM ("""
        + " UNION ALL ".join([*parts, tv])
        + ")"
    )


def _drift(t):
    old = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    base = t.lineitem.select("l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice")
    now = base.filter(~old).withColumn("l_quantity", F.col("l_quantity") * 1.3)
    return monitor.drift(base.filter(old), now, ["l_quantity", "l_extendedprice"], ["l_returnflag"])


@query("drift_psi", "L12", _psi_sql())
def drift_psi(t):
    """Shift of two numeric and one categorical column between old and new line items."""
    return _drift(t).withColumn("shift", F.round("shift", 6))


@query(
    "retrain_trigger",
    "L13",
    f"""WITH d AS (SELECT model_id, CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE predicted_value = actual_value) AS ok FROM predictions GROUP BY 1, 2),
    shift AS (SELECT coalesce(bool_or(drifted), FALSE) AS drifted FROM ({_psi_sql()})),
    a AS (SELECT model_id, sum(ok) OVER w / sum(n) OVER w < 0.85 AS low FROM d WINDOW w AS (PARTITION BY model_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)),
    m AS (SELECT id AS model_id, CAST(DATE '2024-01-01' + CAST(id % 60 AS INTEGER) AS DATE) AS tr FROM models)
    SELECT m.model_id, tr + INTERVAL 1 MONTH <= DATE '2024-02-15' AS calendar_due, coalesce(bool_or(low), FALSE) AS accuracy_low, drifted,
      tr + INTERVAL 1 MONTH <= DATE '2024-02-15' OR coalesce(bool_or(low), FALSE) OR drifted AS retrain
    FROM m CROSS JOIN shift LEFT JOIN a USING (model_id) GROUP BY m.model_id, tr, drifted""",
    ("predictions", "models"),
)
def retrain_trigger(t):
    """Which models are due by calendar, accuracy or drift."""
    scored = t.predictions.withColumn("was_correct", F.col("predicted_value").eqNullSafe(F.col("actual_value")))
    acc = monitor.rolling_accuracy(scored, ["model_id"], "created_at")
    trained = t.models.select(F.col("id").alias("model_id"), F.expr("date_add(DATE '2024-01-01', CAST(id % 60 AS INT))").alias("trained_at"))
    return monitor.retrain_triggers(trained, acc, _drift(t), "2024-02-15")


_METRICS = """WITH a AS (SELECT 'model_' || model_id AS model, avg(CASE WHEN predicted_value = actual_value THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(confidence) AS conf FROM predictions GROUP BY 1),
  m AS (SELECT model, 'accuracy' AS metric, acc AS value FROM a UNION ALL SELECT model, 'f1', (acc + conf) / 2 FROM a)"""


def _metrics(t):
    a = t.predictions.groupBy(F.concat(F.lit("model_"), F.col("model_id").cast("string")).alias("model")).agg(
        F.avg((F.col("predicted_value") == F.col("actual_value")).cast("double")).alias("acc"), F.avg("confidence").alias("conf")
    )
    return a.select(
        "model",
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("metric"), F.col("acc").alias("value")),
                F.struct(F.lit("f1").alias("metric"), ((F.col("acc") + F.col("conf")) / 2).alias("value")),
            )
        ),
    )


@query(
    "promotion_gate",
    "L11",
    _METRICS
    + """, g AS (SELECT * FROM (VALUES ('staging', 'accuracy', 0.85::DOUBLE), ('production', 'accuracy', 0.90::DOUBLE), ('production', 'f1', 0.7::DOUBLE)) v(stage, metric, minimum))
    SELECT m.model, g.stage, bool_and(value >= minimum) AS passed, round(min(value - minimum), 6) AS margin FROM g JOIN m USING (metric) GROUP BY m.model, g.stage""",
    ("predictions",),
)
def promotion_gate(t):
    """Which models may go to staging and production."""
    rows = [("staging", "accuracy", monitor.GATES["staging"]), ("production", "accuracy", monitor.GATES["production"]), ("production", "f1", 0.7)]
    gates = t.spark.createDataFrame(rows, "stage string, metric string, minimum double")
    return monitor.promotion(_metrics(t), gates).withColumn("margin", F.round("margin", 6))


@query(
    "choose_best",
    "L10",
    _METRICS + " SELECT model, round(value, 6) AS value FROM m WHERE metric = 'f1' ORDER BY value DESC, model LIMIT 1",
    ("predictions",),
)
def choose_best(t):
    """The model with the best F1."""
    return monitor.choose_best(_metrics(t), "f1").withColumn("value", F.round("value", 6))
