"""Evaluation metrics, outcome accuracy, drift and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.windows import running_sum


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, n)``."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1, all from the confusion counts."""
    cm = confusion(df, label, prediction)
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    by_label = cm.groupBy("label").agg(F.sum("n").alias("support"), hits.alias("tp"))
    by_pred = cm.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    per = by_label.join(by_pred, "label", "left").select(
        "support",
        "tp",
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0)).alias("p"),
        (F.col("tp") / F.col("support")).alias("r"),
    )
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    total = F.sum("support")
    return per.agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("p") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / total).alias("recall"),
        (F.sum(f1 * F.col("support")) / total).alias("f1"),
        total.alias("n"),
    )


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half.

    Rows collapse to one per distinct score on the map side; the running count of negatives below a score
    goes over quantile buckets of the scores, so no single task orders all of them.
    """
    per = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) == 0).cast("bigint")).alias("neg")
    )
    ranked = running_sum(per.withColumn("one", F.lit(1)), ["one"], ["score"], "neg", "upto")
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") + F.col("neg") / 2.0))
    return ranked.agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def log_loss(df: DataFrame, label: str, probability: str, eps: float = 1e-15) -> DataFrame:
    """Mean negative log likelihood of a 0/1 label, and accuracy at a threshold of one half, over rows that have both."""
    p = F.when(F.col(probability) < eps, eps).when(F.col(probability) > 1 - eps, 1 - eps).otherwise(F.col(probability))
    loss = -F.when(F.col(label) == 1, F.log(p)).when(F.col(label).isNotNull(), F.log(F.lit(1.0) - p))
    hit = ((F.col(probability) >= 0.5).cast("int") == F.col(label)).cast("double")
    return df.agg(F.avg(loss).alias("log_loss"), F.avg(hit).alias("accuracy"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    d = F.col(label) - F.col(prediction)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def outcomes(predictions: DataFrame, actuals: DataFrame, key: str = "id") -> DataFrame:
    """Predictions joined to real outcomes with ``was_correct``; null equals null."""
    return predictions.join(actuals, key).withColumn("was_correct", F.col("predicted_value").eqNullSafe(F.col("actual_value")))


def accuracy_by(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("was_correct").cast("double")).alias("accuracy"))


def rolling_accuracy(scored: DataFrame, keys: list[str], ts: str, days: int = 7, threshold: float = 0.85) -> DataFrame:
    """Accuracy over the trailing days per key and day, with the retrain flag.

    Rows are combined per day first, so a window group holds one row per day.
    """
    daily = scored.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("was_correct")).alias("ok")
    )
    w = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    share = F.sum("ok").over(w) / F.sum("n").over(w)
    return daily.select(*keys, "day", F.sum("n").over(w).alias("n"), share.alias("accuracy")).withColumn(
        "retrain", F.col("accuracy") < threshold
    )


# --- drift ----------------------------------------------------------------------------------------


def _bin(value: Column, edges: list[float]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (value > F.lit(e)).cast("int")
    return out


def psi(baseline: DataFrame, current: DataFrame, cols: list[str], bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index per numeric column on the baseline's exact quantile bins."""
    edges = {c: sorted(set(q)) for c, q in exact_quantiles(baseline, cols, [i / bins for i in range(1, bins)]).items()}

    def counted(df: DataFrame, side: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), _bin(F.col(c), edges[c])).alias("bin")) for c in cols])
        rows = df.select(F.inline(cells)).filter("bin IS NOT NULL").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
        return rows.withColumn(side, F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).drop("n")

    # the missing cells of either side count as empty
    grid = baseline.sparkSession.createDataFrame([(c, i) for c in cols for i in range(len(edges[c]) + 1)], "feature string, bin int")
    joined = grid.join(counted(baseline, "p"), ["feature", "bin"], "left").join(counted(current, "q"), ["feature", "bin"], "left")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(eps)) for c in ("p", "q"))
    return joined.groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("shift"))


def total_variation(baseline: DataFrame, current: DataFrame, cols: list[str]) -> DataFrame:
    """Half the absolute difference of the value shares, per categorical column."""

    def counted(df: DataFrame, sign: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])
        rows = df.select(F.inline(cells)).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        totals = rows.groupBy("feature").agg(F.sum("n").alias("total"))
        return rows.join(totals, "feature").select("feature", "value", (F.lit(sign) * F.col("n") / F.col("total")).alias("share"))

    both = counted(baseline, 1).unionByName(counted(current, -1)).groupBy("feature", "value").agg(F.sum("share").alias("d"))
    return both.groupBy("feature").agg((F.sum(F.abs("d")) / 2).alias("shift"))


def drift(baseline: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str], threshold: float = 0.1) -> DataFrame:
    """``(feature, kind, shift, drifted)`` for all columns."""
    parts = []
    if numeric:
        parts.append(psi(baseline, current, numeric).withColumn("kind", F.lit("psi")))
    if categorical:
        parts.append(total_variation(baseline, current, categorical).withColumn("kind", F.lit("total_variation")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("drifted", F.col("shift") > threshold)


def retrain_triggers(last_trained: DataFrame, accuracy: DataFrame, drifted: DataFrame, as_of: str, months: int = 1) -> DataFrame:
    """Per model: due by calendar, by accuracy or by drift, and whether any holds."""
    low = accuracy.groupBy("model_id").agg(F.max("retrain").alias("accuracy_low"))
    any_drift = drifted.agg(F.coalesce(F.max("drifted"), F.lit(False))).scalar()
    due = F.add_months(F.to_date("trained_at"), months) <= F.to_date(F.lit(as_of))
    out = last_trained.join(low, "model_id", "left").select(
        "model_id", due.alias("calendar_due"), F.coalesce("accuracy_low", F.lit(False)).alias("accuracy_low"), any_drift.alias("drifted")
    )
    return out.withColumn("retrain", F.col("calendar_due") | F.col("accuracy_low") | F.col("drifted"))


# --- promotion ------------------------------------------------------------------------------------

# Accuracy gates of the model registry.
GATES = {"staging": 0.85, "production": 0.90}


def promotion(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Per model and stage: open when every gated metric was measured and reaches its minimum.

    ``metrics`` has ``model, metric, value``; ``gates`` has ``stage, metric, minimum``.
    """
    needed = gates.withColumn("needed", F.count(F.lit(1)).over(Window.partitionBy("stage")))
    judged = metrics.join(F.broadcast(needed), "metric")  # gates are a handful of configured rows
    return judged.groupBy("model", "stage").agg(
        (F.bool_and(F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False))) & (F.count(F.lit(1)) == F.max("needed"))).alias("passed"),
        F.min(F.col("value") - F.col("minimum")).alias("margin"),
    )


def choose_best(metrics: DataFrame, metric: str = "f1") -> DataFrame:
    """The model with the best value of one metric, the first name on ties."""
    best = F.min(F.struct((-F.col("value")).alias("neg"), "model")).alias("b")
    return metrics.filter(F.col("metric") == metric).agg(best).select(F.col("b.model").alias("model"), (-F.col("b.neg")).alias("value"))
