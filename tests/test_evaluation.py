"""Stratified folds, and tools registered by name."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tools, training


@pytest.mark.parametrize("folds", [2, 5, 7])
def test_stratified_folds_are_even(spark, folds):
    """Every class, null and rare ones included, differs by at most one row between folds; keys may be null or repeat."""
    df = spark.range(1000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 7 = 0 THEN 7 ELSE id END AS k",
        "CASE WHEN id < 2 THEN 'rare' WHEN id % 3 = 0 THEN NULL WHEN id % 5 = 0 THEN 'b' ELSE 'a' END AS y",
        "id AS fold_input",
    )
    rows = training.stratified_folds(df, "k", "y", folds).collect()
    assert sorted(r["fold_input"] for r in rows) == list(range(1000))
    per = Counter((r["y"], r["fold"]) for r in rows)
    assert all(0 <= r["fold"] < folds for r in rows)
    for label in {r["y"] for r in rows}:
        sizes = [per[label, f] for f in range(folds)]
        assert max(sizes) - min(sizes) <= 1, (label, sizes)


def test_stratified_folds_of_nothing(spark):
    df = spark.createDataFrame([], "k long, y string")
    assert training.stratified_folds(df, "k", "y").count() == 0
    assert training.stratified_folds(spark.range(3).withColumn("y", F.lit("a")), "id", "y", 1).filter("fold = 0").count() == 3


def test_toolbox(spark):
    box = tools.Toolbox().add("rows", lambda: F.count(F.lit(1))).add("top", lambda: F.max("id"))
    got = {(r["part"], r["tool"]): r["value"] for r in box.run(spark.range(10).withColumn("part", F.col("id") % 2), ["top", "rows"], ["part"]).collect()}
    assert got == {(0, "rows"): 5.0, (1, "rows"): 5.0, (0, "top"): 8.0, (1, "top"): 9.0}
    assert box.run(spark.range(0), ["rows", "top"]).collect() == [("rows", 0.0), ("top", None)]
    with pytest.raises(ValueError):
        box.add("rows", lambda: F.lit(1))
    with pytest.raises(KeyError, match="known: rows, top"):
        box.run(spark.range(1), ["nope"])


def test_compared_learners_are_trained_as_configured(spark, monkeypatch):
    from tidemark.plans import load_all
    from tidemark.plans.registry import QUERIES

    load_all()
    seen = {}
    real = training.train

    def learn(kind, df, **params):
        seen[kind] = params, sorted(r["id"] for r in df.collect())
        return real("logistic_regression", df, maxIter=1)

    monkeypatch.setattr(training, "train", learn)
    rows = QUERIES["compare_models"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 16 and {r["model"] for r in rows} == set(seen)
    assert {r["model"] for r in rows if r["is_best"]} == {"gradient_boosting"}  # all are alike here: the first name
    params = {kind: p for kind, (p, _) in seen.items()}
    assert params["random_forest"].items() >= training.FOREST.items() and training.FOREST["numTrees"] == 100 and training.FOREST["maxDepth"] == 20
    assert params["gradient_boosting"] == training.BOOSTING and training.BOOSTING["maxIter"] == 100 and training.BOOSTING["maxDepth"] == 6
    assert params["logistic_regression"]["maxIter"] == 1000 and params["svm"]["maxIter"] == 2**31 - 1
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    ids = [i for _, i in seen.values()]
    assert all(i == ids[0] for i in ids) and len(set(ids[0])) == len(ids[0]) and abs(len(ids[0]) - 0.8 * parts) <= 2


def test_dealt_rows_are_all_there_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(training, "PART_ROWS", (10, 40))
    df = spark.range(1000).withColumn("x", F.col("id") * 2.0)
    for n, parts in ((0, 1), (9, 1), (35, 3), (200, 8), (1000, 25)):
        out = training.dealt(df.filter(F.col("id") < n), "id", n)
        assert sorted(r["id"] for r in out.collect()) == list(range(n))
        got = [r["c"] for r in out.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("c")).collect()]
        assert len(got) <= parts and (n < 200 or len(got) > parts // 2)
        assert out.columns == df.columns
