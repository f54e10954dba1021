"""Searches whose rows meet only the places that can hold an answer, held against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import questions, vector


def _random(spark, n, width, seed):
    m = np.random.default_rng(seed).normal(size=(n, width))
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")


def test_small_lists_share_a_place_and_large_ones_are_cut():
    first, number = vector._places([3, 4, 0, 25, 2, 2], 10)
    assert list(zip(first, number)) == [(0, 1), (0, 1), (0, 0), (1, 3), (4, 1), (4, 1)]
    first, number = vector._places([3, 4, 2], 10, kinds=[0, 0, 1])
    assert first.tolist() == [0, 0, 1] and number.tolist() == [1, 1, 1]
    assert sorted(vector._chain(np.random.default_rng(0).normal(size=(9, 3)))) == list(range(9))


def test_a_query_is_sent_to_a_place_once_however_many_lists_it_needs(spark):
    m, corpus = _random(spark, 500, 32, 5)  # nothing can be skipped between directions without any order
    centres = m[:22] / np.linalg.norm(m[:22], axis=1)[:, None]
    sizes, _ = vector._sizes(vector._listed(corpus, centres), 22)
    assert sum(sizes) == 500
    first, number = vector._places(sizes, 250, vector._chain(centres))
    asked = vector._asked(corpus.withColumnRenamed("id", "query_id"), centres, first, number, lambda near: np.ones(near.shape, bool))
    places = int((first + number).max())
    assert places <= 4 and asked.count() == 500 * places
    bare = vector._asked(corpus.withColumnRenamed("id", "query_id"), centres, first, number, lambda near: near > 0.9, bare=True)
    assert bare.count() <= 22 * 8 and bare.columns == ["list"]


def test_answers_are_retrieved_from_every_document_of_their_table(spark):
    m, docs = _random(spark, 240, 6, 6)
    tables = sorted(set(questions.text.DOMAIN_TABLE.values()))
    named = F.get(F.array(*[F.lit(x) for x in tables]), (F.col("id") % len(tables)).cast("int"))
    docs = docs.withColumn("vector_table", named)
    asked = docs.withColumnRenamed("id", "query_id")
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    s = np.round(unit @ unit.T, 12)
    got = {}
    for r in questions.retrieve(asked, docs, 3, 0.3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for i in range(240):
        best = sorted((-s[i, j], j) for j in range(240) if j % len(tables) == i % len(tables) and s[i, j] > 0.3)[:3]
        assert sorted(got.get(i, [])) == [(n + 1, j) for n, (_, j) in enumerate(best)]


def _gaps(spark, n, seed):
    rng = np.random.default_rng(seed)
    m = np.stack([rng.integers(0, 12, n).astype(float), rng.normal(size=n).round(2), rng.integers(0, 9, n) * 0.5], axis=1)
    m[: n // 3, 0] = 4.0  # a third at one value
    m[rng.random((n, 3)) < 0.2] = np.nan
    rows = [(int(i), *[None if np.isnan(x) else float(x) for x in v]) for i, v in enumerate(m)]
    return m, spark.createDataFrame(rows, "id long, a double, b double, c double")


def _filled(m, k):
    out = m.copy()
    for i in np.flatnonzero(np.isnan(m).any(axis=1)):
        apart = m[i] - m
        both = (~np.isnan(apart)).sum(axis=1)
        far = np.sqrt(np.round(np.nansum(apart**2, axis=1), 9) * 3 / np.maximum(both, 1))
        for c in np.flatnonzero(np.isnan(m[i])):
            usable = [j for j in range(len(m)) if j != i and both[j] and not np.isnan(m[j, c])]
            best = sorted(usable, key=lambda j: (far[j], j))[:k]
            out[i, c] = m[best, c].mean() if best else np.nanmean(m[:, c])
    return out


@pytest.mark.parametrize("cells, block", [(2048, 10**6), (40, 24 * 30), (1, 10**6)])
def test_knn_by_cells_equals_brute_force(spark, cells, block, monkeypatch):
    monkeypatch.setattr(vector, "CELL_ROWS", 8)
    monkeypatch.setattr(vector, "LEAF_ROWS", 4)
    monkeypatch.setattr(vector, "CHUNK_ROWS", 50)
    m, df = _gaps(spark, 400, 7)
    got = np.array(sorted(map(tuple, vector.knn_impute(df, "id", ["a", "b", "c"], k=3, block_values=block, cells=cells).collect())), dtype=float)
    assert np.allclose(got[:, 1:], _filled(m, 3), atol=1e-9)


def test_knn_of_many_spaces_meets_all_parts(spark, monkeypatch):
    monkeypatch.setattr(vector, "SPACES", 1)
    m, df = _gaps(spark, 150, 8)
    got = np.array(sorted(map(tuple, vector.knn_impute(df, "id", ["a", "b", "c"], k=3, block_values=24 * 40).collect())), dtype=float)
    assert np.allclose(got[:, 1:], _filled(m, 3), atol=1e-9)


def test_boxes_leave_few_cells():
    v = np.random.default_rng(9).normal(size=(4000, 2)) + 1e9
    leaf = vector._leaf(vector._tree(v, [0, 1], 64), v)
    assert len(np.unique(leaf)) == 64 and np.bincount(leaf).max() < 100
    low, high = (np.array([f(v[leaf == i], axis=0) for i in range(64)]) for f in (np.min, np.max))
    hit, bound = vector._reach(v, low, high, np.bincount(leaf), [0, 1], 5)
    assert hit.sum(axis=1).mean() < 12
    for i in range(0, 4000, 97):
        square = ((v[i] - v) ** 2).sum(axis=1)
        assert set(leaf[np.argsort(square)[:6]]) <= set(np.flatnonzero(hit[i])) and np.sort(square)[5] <= bound[i]


def test_ellipsoid_steps_stop_once_settled_with_the_same_distance(spark):
    from tidemark.functions import geo

    rng = np.random.default_rng(10)
    rows = [tuple(map(float, r)) for r in np.stack([rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)], axis=1)]
    rows += [(10.0, 20.0, -10.0, -160.0), (0.0, 0.0, 0.0, 179.9), (5.0, 5.0, 5.0, 5.0), (90.0, 0.0, -90.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    km = [F.col(c) for c in "abcd"]
    out = df.select(geo.geodesic_km(*km).alias("few"), geo.geodesic_km(*km, steps=40).alias("many"))
    # where the steps settle, further ones change nothing; where they do not, the great circle stands in both times
    assert all(r["few"] == r["many"] for r in out.collect())
    assert "move = 0.0" in out._jdf.queryExecution().toString()


class _Seen(Exception):
    pass


def test_learners_read_stored_parts(spark, monkeypatch):
    from tidemark.operators import training
    from tidemark.plans import load_all
    from tidemark.plans.registry import QUERIES

    load_all()
    seen = []

    def learn(kind, df, **params):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise _Seen

    monkeypatch.setattr(training, "train", learn)
    with pytest.raises(_Seen):
        QUERIES["compare_models"](spark, "/root/testdata/sf0.001")
    assert "md5" not in seen[0] and "Window" not in seen[0]

    def fold(df, *args):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise _Seen

    monkeypatch.setattr(training, "stratified_folds", fold)
    for name in ("cross_validate", "grid_folds"):
        with pytest.raises(_Seen):
            QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "md5" not in seen[-1], name
