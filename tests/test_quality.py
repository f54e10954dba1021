"""Golden values of the quality operators and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, profile, quantiles, stages, validate


def by_check(report):
    return {r["check"]: r for r in report.filter("column = '*'").collect()}


def test_validate_people(people):
    report = validate.validate(
        people,
        expected_columns=["id", "name", "age", "salary", "department"],
        max_missing_percent=10.0,
        value_ranges={"age": (0, 90)},
    )
    checks = by_check(report)
    assert checks["schema"]["status"] == "passed"
    assert (checks["missing_values"]["status"], checks["missing_values"]["percent"]) == ("warning", 4.0)
    assert (checks["duplicates"]["status"], checks["duplicates"]["percent"]) == ("failed", 20.0)
    assert (checks["outliers"]["status"], checks["outliers"]["count"]) == ("warning", 1)
    assert (checks["value_ranges"]["status"], checks["value_ranges"]["count"]) == ("failed", 1)
    row = validate.rollup(report).first()
    assert (row["passed"], row["failed"], row["warnings"], row["validation_passed"]) == (1, 2, 2, False)


def test_validate_empty_table(people):
    checks = by_check(validate.validate(people.limit(0), expected_columns=["id", "extra"]))
    assert checks["missing_values"]["status"] == "empty"
    assert checks["duplicates"]["status"] == "empty"
    assert checks["schema"]["count"] == 5


def test_profile_people(people):
    rows = {r["column"]: r for r in profile.profile_numeric(people).collect()}
    age = rows["age"]
    assert (age["q25"], age["q50"], age["q75"], age["mean"]) == (25, 30, 35, 43)
    assert age["std"] == pytest.approx(32.132538, abs=1e-6)
    assert (rows["salary"]["q25"], rows["salary"]["q50"], rows["salary"]["q75"]) == (50000, 55000, 65000)
    assert rows["salary"]["std"] == pytest.approx(14142.135624, abs=1e-6)
    score = profile.quality_score(people).first()
    assert (score["missing_values"], score["duplicate_rows"], score["quality_score"]) == (1, 1, 94.0)
    corr = {(r[0], r[1]): r[2] for r in profile.correlations(people).collect()}
    assert corr["id", "age"] == pytest.approx(0.847342, abs=1e-6)
    assert corr["id", "salary"] == pytest.approx(1.0)
    assert corr["age", "salary"] == pytest.approx(0.962250, abs=1e-6)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (1.0, None, 3.0)], "a double, b double, c double")
    assert profile.correlations(df).count() == 0
    rows = {r["column"]: r for r in profile.profile_numeric(df).collect()}
    assert rows["b"]["q50"] is None and rows["b"]["missing"] == 2
    scaled = stages.Scale("minmax").fit_transform(df).collect()
    assert [r["a"] for r in scaled] == [0.0, 0.0]
    assert [r["b"] for r in scaled] == [None, None]
    assert [r["a"] for r in stages.Scale("robust").fit_transform(df).collect()] == [0.0, 0.0]


def test_clean_people(people):
    out = clean.clean(people, ["remove_duplicates", "fill_missing", "remove_outliers"])
    rows = {r["id"]: r for r in out.collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[3]["salary"] == 60000
    change = clean.before_after(people, out).first()
    assert (change["before_score"], change["after_score"], change["improvement_percent"]) == (96.0, 100.0, 4.0)


def test_standard_scale_is_population(people):
    row = stages.Scale("standard", ["age"]).fit_transform(people).filter("id = 1").first()
    assert row["age"] == pytest.approx(-0.626300, abs=1e-6)


@pytest.mark.parametrize("shape", ["uniform", "heavy", "ties", "tails"])
def test_selected_quantiles_equal_direct_ones(spark, shape):
    rnd = random.Random(7)
    make = {
        "uniform": lambda i: rnd.random(),
        "heavy": lambda i: 5.0 if i % 3 == 0 else rnd.gauss(0, 1),
        "ties": lambda i: float(rnd.randrange(4)),
        "tails": lambda i: rnd.paretovariate(0.2) * (-1) ** i,
    }[shape]
    df = spark.createDataFrame([(make(i), None if i % 5 == 0 else float(i)) for i in range(20000)], "x double, y double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    direct = quantiles.exact_quantiles(df, ["x", "y"], probs)
    builtin = df.agg(*[F.percentile(c, F.lit(probs)) for c in ("x", "y")]).first()
    assert direct["x"] == pytest.approx(builtin[0], rel=1e-12) and direct["y"] == pytest.approx(builtin[1], rel=1e-12)
    for few in (0, 10, 3000):
        picked = quantiles.exact_quantiles(df, ["x", "y"], probs, few=few)
        for c in ("x", "y"):
            assert picked[c] == pytest.approx(direct[c], rel=1e-12)


def test_quantiles_of_odd_numbers(spark):
    inf = float("inf")
    values = [-inf, -1e300, -3.0, -1e-310, -0.0, 0.0, 5e-324, 2.0, 2.0, 1e300, inf]
    rows = [(v, None, float("nan") if i else 7.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    for few in (0, 100):
        got = quantiles.exact_quantiles(df, ["x", "y", "z"], [i / 10 for i in range(11)], few)
        assert got["x"] == values and got["y"] == [None] * 11 and got["z"] == [7.0] * 11
    assert quantiles.exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]} and quantiles.exact_quantiles(df, [], [0.5]) == {}
    numbers = [quantiles._number(int(t)) for t in quantiles._turned(np.array(values))]
    assert numbers == values


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    label = stages.LabelEncode(["c"]).fit(df)
    assert [r["c"] for r in label.transform(df).collect()] == [1, 0, 2, 1]
    new = spark.createDataFrame([("z",)], "c string")
    with pytest.raises(Exception, match="unseen value"):
        label.transform(new).collect()
    assert stages.LabelEncode(["c"], unseen=-1).fit(df).transform(new).first()["c"] == -1
    hot = stages.OneHot(["c"]).fit(df)
    assert hot.transform(new).first().asDict() == {"c_a": 0, "c_b": 0}
    sparse = stages.OneHot(["c"], max_values=1).fit(df)
    assert [r["c_index"] for r in sparse.transform(df).collect()] == [1, 0, 2, 1] or sparse.transform(df).columns == ["c_index"]
    assert sparse.transform(new).first()["c_index"] is None


@pytest.mark.parametrize("limit", [0, 10**6])
def test_large_dictionary_paths(spark, monkeypatch, limit):
    monkeypatch.setattr(stages, "INLINE_VALUES", 0)
    monkeypatch.setattr(stages, "BROADCAST_VALUES", limit)
    words = [f"w{(i * 37) % 101:03d}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "c string")
    enc = stages.LabelEncode(["c"], suffix="_code").fit(df)
    order = {w: i for i, w in enumerate(sorted(set(words)))}
    assert all(order[r["c"]] == r["c_code"] for r in enc.transform(df).collect())
    back = enc.dictionaries["c"].value(enc.transform(df).select(F.col("c_code").cast("double").alias("i"), "c"), "i", "again")
    assert back.filter("c <> again OR again IS NULL").count() == 0


def test_modes_take_smallest_tie(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("b", 2.0), ("a", 1.0), (None, None)], "c string, n double")
    assert stages.modes(df, ["c", "n"]) == {"c": "a", "n": 1.0}
    empty = df.filter("c = 'zzz'")
    assert stages.FillMissing().fit_transform(empty).count() == 0


def test_failed_feature_is_recorded(people):
    stage = stages.Features({"ok": F.col("age") + 1, "bad": lambda d: d["nope"]})
    out = stage.fit_transform(people)
    assert "ok" in out.columns and "bad" not in out.columns and "bad" in stage.failed


def test_preprocess_inverse(people):
    prep = stages.Preprocess("department").fit(people)
    out = prep.transform(people)
    back = prep.inverse_target(out.select("label", F.col("id")), "label", "again").join(people, "id")
    assert back.filter("again <> department").count() == 0
    assert prep.feature_names == ["id", "age", "salary", "name"]


def test_field_formats(spark):
    rules = validate.field_format_rules()
    df = spark.createDataFrame([("ab", "IN", 0, 1001), ("user_1", "in", 5, 1000)], "u string, c string, s int, n int")
    bad = df.select(rules["username"]("u"), rules["iso2_country"]("c"), rules["score"]("s"), rules["batch_size"]("n")).collect()
    assert [tuple(r) for r in bad] == [(True, False, True, True), (False, False, False, False)]


def test_rule_chain_split(spark):
    df = spark.createDataFrame([(91.0, 0.0), (10.0, 10.0), (None, 200.0)], "latitude double, longitude double")
    chain = validate.Validation().coordinates()
    good, bad = chain.split(df)
    assert good.count() == 1 and bad.count() == 2
    assert chain.is_valid(chain.issues(df)).first()["is_valid"] is False
    assert chain.is_valid(chain.issues(good.select("latitude", "longitude"))).first()["is_valid"] is True
