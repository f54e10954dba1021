"""Splitting, training, scoring and question-answering queries."""

from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels, text
from tidemark.operators import clean, monitor, profile, questions, stages, training, validate
from tidemark.plans.registry import query
from tidemark.session import cut_lineage, scratch_path
from tidemark.sources import synth

LAND = [*labels.LAND_RANGES, "month"]
DROUGHT = [*labels.DROUGHT_RANGES, "month"]
LINEAR_ROWS = 250_000


@query(
    "split_stratified",
    "L2",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':42'), o_orderkey)
      <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS part FROM orders""",
)
def split_stratified(t):
    """Exact 80/20 split per order status."""
    train, test = training.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "fold_assignment",
    "L3",
    """SELECT o_orderkey, CAST(CAST('0x' || substr(md5(o_orderkey || ':42'), 9, 8) AS UBIGINT) % 5 AS INTEGER) AS fold FROM orders""",
)
def fold_assignment(t):
    """Hashed fold of every order."""
    return t.orders.select("o_orderkey", training.fold_of("o_orderkey", 5).alias("fold"))


@query(
    "time_series_folds",
    "L3",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS fold, (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '{a}') AS train_rows, "
        f"(SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '{a}'{f' AND o_orderdate < TIMESTAMP {b!r}' if b else ''}) AS test_rows"
        for i, (a, b) in enumerate((("1996-01-01", "1997-01-01"), ("1997-01-01", "1998-01-01"), ("1998-01-01", None)))
    ),
)
def time_series_folds(t):
    """Sizes of expanding-window folds."""
    parts = [
        tr.agg(F.count(F.lit(1)).alias("train_rows")).select(F.lit(i).alias("fold"), "train_rows", te.agg(F.count(F.lit(1))).scalar().alias("test_rows"))
        for i, (tr, te) in enumerate(training.time_folds(t.orders, "o_orderdate", ["1996-01-01", "1997-01-01", "1998-01-01"]))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _land(t):
    rows = synth.land_rows(t.part.select(F.col("p_partkey").alias("id")))
    return rows.select("id", F.array(*[F.col(c).cast("double") for c in LAND]).alias("features"), F.col("label").cast("double").alias("label"))


@query("train_eval_rf", "L1 A20")
def train_eval_rf(t):
    """Random forest on land-change rows: test metrics (learned trees, so without SQL)."""
    train, test = training.stratified_split(_land(t), "id", "label")
    model = training.train("random_forest", train, classes=4, numTrees=20, maxDepth=8, seed=42)
    return training.evaluate(training.predict(model, test), "random_forest")


@query("compare_models", "L1 L10 L11 L15")
def compare_models(t):
    """Forest, boosting, logistic regression and support vectors, as configured, compared, best F1 marked."""
    rows = cut_lineage(_land(t).withColumn("label", (F.col("label") > 0).cast("double")))
    n = rows.count()
    # four learners pass over both parts many times: the split is worked out once
    train, test = (training.dealt(part, "id", n) for part in training.stratified_split(rows, "id", "label"))
    few = train.coalesce(max(1, n // LINEAR_ROWS))  # their many passes are short
    learners = {
        "svm": (few, training.SUPPORT),
        "gradient_boosting": (train, training.BOOSTING),
        "random_forest": (train, {**training.FOREST, "cacheNodeIds": True}),  # the same trees, without walking down each for every level
        "logistic_regression": (few, training.LOGISTIC),
    }

    def measured(kind):
        seen, params = learners[kind]
        return cut_lineage(training.evaluate(training.predict(training.train(kind, seen, **params), test), kind))

    # boosting and the linear learners wait for many small jobs, so all go side by side, each with job properties of its own
    tasks = [inheritable_thread_target(t.spark)(partial(measured, kind)) for kind in learners]
    with ThreadPool(len(tasks)) as pool:
        out = reduce(DataFrame.unionByName, pool.map(lambda task: task(), tasks))
    best = monitor.choose_best(out, "f1").select(F.col("model").alias("best"))
    return out.join(F.broadcast(best), F.col("model") == F.col("best"), "left").withColumn("is_best", F.col("best").isNotNull()).drop("best")


@query("cross_validate", "L3 L4")
def cross_validate(t):
    """Five-fold accuracy of a small grid: mean and population deviation per setting."""
    est = training.estimator("random_forest", 4, seed=42, numTrees=5)
    grid = training.grid(est, maxDepth=[4, 8])
    cv = training.cross_validate(_land(t), est, "id", 5, grid)
    rows = [(int(p[est.maxDepth]), float(m), float(s)) for p, m, s in zip(grid, cv.avgMetrics, cv.stdMetrics)]
    return t.spark.createDataFrame(rows, "max_depth int, mean_accuracy double, std_accuracy double")


@query("drought_regression", "L5 A22")
def drought_regression(t):
    """Forest regression of drought severity: error on the test part."""
    rows = synth.drought_rows(t.part.select(F.col("p_partkey").alias("id")))
    rows = rows.select("id", F.array(*[F.col(c).cast("double") for c in DROUGHT]).alias("features"), F.col("target").alias("label"))
    fold = training.fold_of("id", 5)
    train, test = rows.filter(fold != 0), rows.filter(fold == 0)
    model = training.train_regressor(train, numTrees=20, maxDepth=8, seed=42)
    return monitor.regression_metrics(training.predict(model, test), "label", "prediction")


@query("batch_score", "L6 L7 P14")
def batch_score(t):
    """All rows scored; rows lacking a feature are returned with what they lack."""
    train, _ = training.stratified_split(_land(t), "id", "label")
    model = training.train("logistic_regression", train, maxIter=20)
    rows = synth.land_rows(t.part.select(F.col("p_partkey").alias("id")))
    full = F.create_map(*[x for c in LAND for x in (F.lit(c), F.col(c).cast("double"))])
    feats = F.when(F.col("id") % 50 == 0, F.map_filter(full, lambda k, _: k != "month")).otherwise(full)
    scored, rejected = training.batch_predict(model, rows.select("id", feats.alias("features")), "features", LAND)
    good = scored.select("id", F.lit("scored").alias("state"), F.col("prediction").cast("int").alias("label"), F.round("confidence", 4).alias("confidence"), F.lit("").alias("missing"))
    bad = rejected.select(
        "id", F.lit("rejected").alias("state"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("confidence"), F.array_join("missing_features", ",").alias("missing")
    )
    return good.unionByName(bad)


@query("feature_importance", "L8 L9")
def feature_importance(t):
    """Importances of a forest that was stored and loaded again, and whether both score alike."""
    from pyspark.ml.classification import RandomForestClassificationModel

    rows = _land(t)
    model = training.train("random_forest", rows, classes=4, numTrees=10, maxDepth=6, seed=42)
    path = scratch_path(t.spark, "forest")
    training.save(model, path)
    loaded = RandomForestClassificationModel.load(path)
    a = training.predict(model, rows).select("id", "prediction")
    b = training.predict(loaded, rows).select("id", F.col("prediction").alias("again"))
    differing = a.join(b, "id").agg(F.count_if(F.col("prediction") != F.col("again"))).scalar()
    return training.importances(loaded, LAND).withColumn("differing_rows", differing)


@query("training_job", "L18 L10 L11 S14")
def training_job(t):
    """Validate, clean, encode, expand, select, train three models, evaluate and gate, each step a table."""
    df = t.customer_dirty.withColumn("target", (F.coalesce("c_acctbal", F.lit(0.0)) > 4000).cast("string"))
    df = df.withColumn("age_group", (F.col("c_custkey") % 7).cast("double"))
    issues = validate.Validation().schema(["c_custkey"]).quality(50.0).issues(df)
    if issues.filter("level = 'ERROR'").limit(1).count():
        raise ValueError("input failed validation")
    tidy = clean.clean(df, ["remove_duplicates"]).dropDuplicates(["c_custkey"]).drop("c_acctbal")  # the label is made of it
    train, test = (cut_lineage(part) for part in training.stratified_split(cut_lineage(tidy), "c_custkey", "target"))
    prep = stages.Preprocess("target").fit(train.drop("c_custkey"))
    poly = stages.Polynomial(["c_nationkey", "age_group"])
    wide = poly.transform(prep.transform(train))
    candidates = [*prep.feature_names, "c_nationkey^2", "c_nationkey*age_group", "age_group^2"]
    safe = {c: c.replace("^", "_pow_").replace("*", "_x_") for c in candidates}
    wide = wide.withColumnsRenamed(safe)
    chosen = stages.select_k_best(stages.anova_f(wide, list(safe.values()), "label"), "f_score", 5)

    def ready(part):
        out = poly.transform(prep.transform(part)).withColumnsRenamed(safe)
        return out.select(F.array(*[F.col(c).cast("double") for c in chosen]).alias("features"), "label")

    metrics = None
    for kind, params in {
        "random_forest": {"numTrees": 10, "maxDepth": 5, "seed": 42},
        "gradient_boosting": {"maxIter": 5, "maxDepth": 3, "seed": 42},
        "logistic_regression": {"maxIter": 20},
    }.items():
        part = training.evaluate(training.predict(training.train(kind, ready(train), **params), ready(test)), kind)
        metrics = part if metrics is None else metrics.unionByName(part)
    gates = t.spark.createDataFrame([(s, "accuracy", v) for s, v in monitor.GATES.items()], "stage string, metric string, minimum double")
    return metrics.filter("metric = 'accuracy'").select("model", "value").join(monitor.promotion(metrics, gates), "model")


# --- questions ------------------------------------------------------------------------------------

_TABLES = sorted(set(text.DOMAIN_TABLE.values()))


def _like(words):
    return " OR ".join(f"contains(lower(query), '{w}')" for w in words)


_DOMAIN = "CASE " + " ".join(f"WHEN {_like(w)} THEN '{d}'" for d, w in text.DOMAIN_KEYWORDS.items()) + " ELSE 'multi' END"


def _case(key, table):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_SOURCES_JSON = {k: "[" + ",".join(f'"{s}"' for s in v) + "]" for k, v in text.DOMAIN_SOURCES.items()}


def asked_and_documents(t):
    """User turns as questions with an embedding, and the documents of the vector tables."""
    n = t.embeddings.agg(F.count(F.lit(1))).scalar()
    tail = F.get(F.array(*[F.lit(s) for s in (" drought ahead?", " any asteroid?", " forest loss?", " chandrayaan?", "")]), (F.col("conv_id") % 5).cast("int"))
    asked = t.conversations.filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.concat("text", tail).alias("query"),
        ((F.col("conv_id") * 13 + F.col("turn") * 7) % n).alias("vec_id"),
    )
    vectors = t.embeddings.select("vec_id", "embedding")
    docs = vectors.select(
        F.col("vec_id").alias("id"), "embedding", F.get(F.array(*[F.lit(x) for x in _TABLES]), (F.col("vec_id") % len(_TABLES)).cast("int")).alias("vector_table")
    )
    return asked.join(vectors, "vec_id").drop("vec_id"), docs


_FOUND_SQL = f"""WITH n AS (SELECT count(*) AS n FROM embeddings),
    q0 AS (SELECT c.conv_id * 1000 + c.turn AS query_id, c.text || CASE c.conv_id % 5 WHEN 0 THEN ' drought ahead?' WHEN 1 THEN ' any asteroid?' WHEN 2 THEN ' forest loss?' WHEN 3 THEN ' chandrayaan?' ELSE '' END AS query,
        (c.conv_id * 13 + c.turn * 7) % n.n AS vid FROM conversations c, n WHERE role = 'user'),
    q AS (SELECT query_id, query, embedding, {_DOMAIN} AS domain FROM q0 JOIN embeddings ON vid = vec_id),
    r AS (SELECT *, {_case('domain', text.DOMAIN_TABLE)} AS tb FROM q),
    d AS (SELECT vec_id AS id, embedding, ['{"', '".join(_TABLES)}'][1 + vec_id % {len(_TABLES)}] AS tb FROM embeddings),
    s AS (SELECT query_id, round(list_cosine_similarity(r.embedding::DOUBLE[], d.embedding::DOUBLE[]), 12) AS sim, row_number() OVER (PARTITION BY query_id
        ORDER BY round(list_cosine_similarity(r.embedding::DOUBLE[], d.embedding::DOUBLE[]), 12) DESC, id) AS rn FROM r JOIN d ON r.tb = d.tb),
    h AS (SELECT query_id, count(*) AS records, round(max(sim), 3) AS best FROM s WHERE sim > 0.3 AND rn <= 5 GROUP BY query_id)"""


@query(
    "answer_questions",
    "G4",
    f"""{_FOUND_SQL},
    p AS (SELECT r.query_id, domain, {_case('domain', text.DOMAIN_AGENT)} AS agent, coalesce(records, 0) AS records, best,
        CASE WHEN coalesce(records, 0) > 1 THEN 'likely' ELSE 'unlikely' END AS label, CAST(r.query_id % 101 AS INTEGER) AS pc, CAST(r.query_id % 51 AS INTEGER) AS sv FROM r LEFT JOIN h USING (query_id)),
    x AS (SELECT *, CASE WHEN records > 0 THEN ' Analysis backed by ' || records || ' historical records.' ELSE '' END AS note,
        CASE WHEN query_id % 2 = 0 THEN ' Key factors: soil moisture (negative impact), cloud cover (positive impact).' ELSE ' Key factors: cloud cover (positive impact), soil moisture (negative impact).' END AS kf,
        CASE WHEN query_id % 2 = 0 THEN '["soil_moisture","cloud_cover"]' ELSE '["cloud_cover","soil_moisture"]' END AS tf FROM p)
    SELECT query_id, domain, agent, records, best AS best_similarity, label,
      sha256('{{"agent":"' || agent || '","data_sources":' || {_case('domain', _SOURCES_JSON)} || ',"domain":"' || domain || '","label":"' || label || '","query_id":' || query_id || ',"records":' || records || ',"top_features":' || tf || '}}') AS evidence_hash,
      CASE domain WHEN 'astronomy' THEN 'Asteroid observation analysis: ' || label || ' (confidence: ' || pc || '%).' || kf || note
        WHEN 'earth_obs' THEN 'Land change detection: ' || label || ' detected (confidence: ' || pc || '%).' || kf || note
        WHEN 'climate' THEN 'Drought assessment: ' || label || ' — severity score ' || (sv // 10) || '.' || (sv % 10) || '/5.0 (confidence: ' || pc || '%).' || kf || note
        WHEN 'isro' THEN 'ISRO mission query processed.' || note ELSE 'Multi-domain analysis complete.' || kf || note END AS answer FROM x""",
)
def answer_questions(t):
    """Every user turn as a question: domain, retrieved records, evidence hash and answer."""
    asked, docs = asked_and_documents(t)

    def predict(rows):
        k = F.col("query_id")
        strong, weak = F.when(k % 2 == 0, 0.2).otherwise(0.6), F.lit(-0.4)
        return rows.withColumns(
            {
                "label": F.when(F.col("records") > 1, "likely").otherwise("unlikely"),
                "confidence": (k % 101) / F.lit(100.0),
                "severity": (k % 51) / F.lit(10.0),
                "attributions": F.create_map(F.lit("cloud_cover"), strong, F.lit("soil_moisture"), weak),
            }
        )

    return questions.answer(asked, docs, predict)


@query(
    "profile_advice",
    "A7 A19",
    """WITH k AS (SELECT column_name AS name, column_type AS kind FROM (DESCRIBE part)),
    f AS (SELECT (SELECT sum(len(list_filter([p_partkey::VARCHAR, p_name, p_brand, p_type, p_size::VARCHAR, p_retailprice::VARCHAR], lambda x: x IS NULL))) FROM part) AS gaps,
      (SELECT count(*) FROM part) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) AS copies, (SELECT count(*) FROM k WHERE kind = 'VARCHAR') AS texts)
    SELECT 'handle missing values' AS advice FROM f WHERE gaps > 0 UNION ALL SELECT 'remove duplicate rows' FROM f WHERE copies > 0
    UNION ALL SELECT 'encode categorical' FROM f WHERE texts > 0""",
)
def profile_advice(t):
    """Advice rows from the overview of the parts table."""
    q = profile.quality_score(t.part)
    rows = F.array(
        F.when(F.col("missing_values") > 0, F.lit("handle missing values")),
        F.when(F.col("duplicate_rows") > 0, F.lit("remove duplicate rows")),
        F.when(F.col("categorical_columns") > 0, F.lit("encode categorical")),
    )
    return q.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("advice"))
