"""Splitting, training, tuning, scoring and storing models with Spark ML."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import monitor
from tidemark.operators.relational import feature_vector
from tidemark.session import cut_lineage

BROADCAST_CLASSES = 100_000
PART_ROWS = 10_000, 1_000_000

# Configured forest and boosting parameters, in Spark ML's names.
FOREST = {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "seed": 42}
BOOSTING = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42}
BOOSTING_SAMPLED = {**BOOSTING, "featureSubsetStrategy": "0.8"}
LOGISTIC = {"maxIter": 1000}
SUPPORT = {"maxIter": 2**31 - 1}  # no limit: until the loss settles


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test part; per class exactly ``round(test * n)`` rows go to test, chosen by hash of the key.

    The cut is found from counts per (class, hash bucket): whole buckets below it are test, and only the
    rows of the one bucket per class that holds the cut are ranked.
    """
    digest = _digest(key, seed)
    rows = df.withColumn("__digest", digest).withColumn("__bucket", F.conv(F.substring(F.col("__digest"), 1, 4), 16, 10).cast("int"))
    counts = rows.groupBy(label, "__bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(label)
    upto = F.sum("n").over(w.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    want = F.floor(F.sum("n").over(w) * F.lit(test) + 0.5)
    cut = counts.select(label, "__bucket", "n", upto.alias("upto"), want.alias("want"))
    cut = cut.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))).select(
        F.col(label).alias("__class"), F.col("__bucket").alias("__cut"), (F.col("want") - (F.col("upto") - F.col("n"))).alias("__need")
    )
    cut = cut_lineage(cut)  # one row per class
    if cut.count() <= BROADCAST_CLASSES:
        cut = F.broadcast(cut)
    placed = rows.join(cut, F.col(label).eqNullSafe(F.col("__class")), "left")
    at_cut = placed.filter(F.col("__bucket") == F.col("__cut"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__digest", key))
    at_cut = at_cut.withColumn("__test", rank <= F.col("__need"))
    clear = placed.filter(F.col("__cut").isNull() | (F.col("__bucket") != F.col("__cut")))
    clear = clear.withColumn("__test", F.coalesce(F.col("__bucket") < F.col("__cut"), F.lit(False)))
    both = clear.unionByName(at_cut)
    return both.filter(~F.col("__test")).select(*df.columns), both.filter("__test").select(*df.columns)


def fold_of(key: str, folds: int, seed: int = 42) -> Column:
    """Fold number from the key's hash: no pass over the data, sizes even on average."""
    return F.pmod(F.conv(F.substring(_digest(key, seed), 9, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """The rows with a column ``fold``; within each class, null included, fold sizes differ by at most one.

    A class is dealt by hash of the key: counts per (class, hash bucket) place the borders between folds, and only the rows of
    the buckets that hold a border, at most ``folds - 1`` a class, are ranked.
    """
    rows = df.withColumn("__digest", _digest(key, seed))
    rows = rows.withColumn("__bucket", F.conv(F.substring(F.col("__digest"), 1, 4), 16, 10).cast("int"))
    counts = rows.groupBy(F.col(label).alias("__class"), "__bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("__class")
    below = F.sum("n").over(w.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    counts = counts.select("__class", "__bucket", "n", below.alias("below"), F.sum("n").over(w).alias("total"))
    starts = F.transform(F.sequence(F.lit(1), F.lit(max(1, folds - 1))), lambda j: F.ceil(j * F.col("total") / F.lit(folds)))
    inside = F.filter(starts, lambda at: (at >= F.col("below")) & (at < F.col("below") + F.col("n")) & F.lit(folds > 1))
    marks = counts.select("__class", F.explode(F.transform(inside, lambda at: F.struct(F.col("__bucket").alias("b"), (at - F.col("below")).alias("first")))).alias("mark"))
    marks = cut_lineage(marks.groupBy("__class").agg(F.collect_list("mark").alias("__marks")))  # one row per class
    if marks.count() <= BROADCAST_CLASSES:
        marks = F.broadcast(marks)
    placed = rows.join(marks, F.col(label).eqNullSafe(F.col("__class")), "left").withColumn("__marks", F.coalesce("__marks", F.array()))
    passed = F.size(F.filter("__marks", lambda m: m["b"] < F.col("__bucket")))
    cut = F.exists("__marks", lambda m: m["b"] == F.col("__bucket"))
    ranked = placed.filter(cut).withColumn("__rank", F.row_number().over(Window.partitionBy(label, "__bucket").orderBy("__digest", key)) - 1)
    within = F.size(F.filter("__marks", lambda m: (m["b"] == F.col("__bucket")) & (m["first"] <= F.col("__rank"))))
    out = placed.filter(~cut).withColumn("fold", passed).select(*df.columns, "fold")
    return out.unionByName(ranked.withColumn("fold", passed + within).select(*df.columns, "fold"))


def time_folds(df: DataFrame, ts: str, cuts: list[str]) -> list[tuple[DataFrame, DataFrame]]:
    """Expanding windows: train before each cut, test from it to the next."""
    out = []
    for i, cut in enumerate(cuts):
        at = F.lit(cut).cast(df.schema[ts].dataType)
        test = df.filter(F.col(ts) >= at)
        if i + 1 < len(cuts):
            test = test.filter(F.col(ts) < F.lit(cuts[i + 1]).cast(df.schema[ts].dataType))
        out.append((df.filter(F.col(ts) < at), test))
    return out


def estimator(kind: str, classes: int = 2, **params):
    """``random_forest``, ``gradient_boosting``, ``logistic_regression`` or ``svm``; binary ones go one-vs-rest."""
    kinds = {
        "random_forest": RandomForestClassifier,
        "gradient_boosting": GBTClassifier,
        "logistic_regression": LogisticRegression,
        "svm": LinearSVC,
    }
    if kind not in kinds:
        raise ValueError(f"unknown model type: {kind}")
    est = kinds[kind](featuresCol="vector", labelCol="label", **params)
    if classes > 2 and kind in ("gradient_boosting", "svm"):
        return OneVsRest(classifier=est, featuresCol="vector", labelCol="label")
    return est


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows, written in as many parts as there are cores, but with 10,000 to a million rows in each.

    Learners that sample draw by part and place: rows go to parts by hash of the key and are sorted by it.
    """
    least, most = PART_ROWS
    parts = max(1, -(-n // most), min(df.sparkSession.sparkContext.defaultParallelism, n // least))
    return cut_lineage(df.repartition(parts, key).sortWithinPartitions(key))


def vectors(df: DataFrame, features: str = "features") -> DataFrame:
    """Array of doubles to the vector column the estimators read."""
    return df.withColumn("vector", array_to_vector(features))


def train(kind: str, df: DataFrame, classes: int = 2, **params) -> Model:
    return estimator(kind, classes, **params).fit(vectors(df))


def train_regressor(df: DataFrame, **params) -> Model:
    return RandomForestRegressor(featuresCol="vector", labelCol="label", **params).fit(vectors(df))


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Every row scored: ``prediction``, ``confidence`` (largest probability) and the probability map.

    Models without probabilities give a confidence of one; regressors give none.
    """
    out = model.transform(vectors(df))
    if "probability" in out.columns:
        p = vector_to_array("probability")
        names = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i.cast("string"))
        out = out.withColumn("confidence", F.array_max(p)).withColumn(
            "probabilities", F.map_from_arrays(names, F.transform(p, lambda x: F.round(x, 4)))
        )
    else:
        classifier = "rawPrediction" in out.columns
        out = out.withColumn("confidence", F.lit(1.0 if classifier else None).cast("double"))
        out = out.withColumn("probabilities", F.create_map().cast("map<string,double>"))
    return out.drop("vector", "probability", "rawPrediction")


def batch_predict(model: Model, df: DataFrame, features: str, expected: list[str]) -> tuple[DataFrame, DataFrame]:
    """Scored rows and rejected rows (with the names they lack); a bad row never fails the batch."""
    checked = feature_vector(df, features, expected)
    good = checked.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    bad = checked.filter(F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull()))
    scored = predict(model, good.withColumnRenamed("vector", "features_array").withColumn("features_kept", F.col(features)).drop(features).withColumnRenamed("features_array", "features"))
    return scored, bad.drop("vector")


def importances(model: Model, names: list[str]) -> DataFrame:
    """``(feature, importance)``, four decimals."""
    from pyspark.sql import SparkSession

    rows = [(n, round(float(v), 4)) for n, v in zip(names, model.featureImportances.toArray())]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def cross_validate(df: DataFrame, est, key: str, folds: int = 5, grid: list | None = None, parallelism: int = 4) -> CrossValidatorModel:
    """K-fold accuracy, folds stratified by label; ``avgMetrics`` and population ``stdMetrics`` per parameter set.

    The rows are written before they are dealt, because dealing them reads them three times.
    """
    scorer = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    cv = CrossValidator(
        estimator=est,
        estimatorParamMaps=grid or ParamGridBuilder().build(),
        evaluator=scorer,
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    return cv.fit(vectors(cut_lineage(stratified_folds(cut_lineage(df), key, "label", folds))))


def grid(est, **choices: list):
    """All combinations of the named parameters of an estimator."""
    builder = ParamGridBuilder()
    for name, values in choices.items():
        builder = builder.addGrid(est.getParam(name), values)
    return builder.build()


def save(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def evaluate(scored: DataFrame, name: str) -> DataFrame:
    """``(model, metric, value)`` rows of a scored test table."""
    m = monitor.classification_metrics(scored, "label", "prediction")
    kinds = ("accuracy", "precision", "recall", "f1")
    return m.select(F.inline(F.array(*[F.struct(F.lit(name).alias("model"), F.lit(k).alias("metric"), F.col(k).alias("value")) for k in kinds])))
