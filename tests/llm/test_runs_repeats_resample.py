"""Periodic runs, removal of repeated passages and importance resampling against brute force, on small and odd input."""

import math
import random
import re
import sys
import zlib
from collections import Counter
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import spark  # noqa: E402, F401

from tidemark.llm import periodic, queries, recompress, resample, words  # noqa: E402

SCHEMA = "doc_id long, text string, k1 string, score double, spans int, rank string, at long, n_words long"
LONG = " ".join(f"w{zlib.crc32(b'%d' % i) % 997}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, "one"), (4, " \n\t "), (5, LONG), (6, LONG), (7, "one"), (7, "one"), (None, "é " * 200), (None, None),
    (8, "\x00 漢字 \x1f A-b Ab\x00cd"), (9, LONG + " end " + LONG),
]


@pytest.fixture(scope="module")
def odd(spark):  # noqa: F811
    rows = [(i, t, "clash", 0.5, 1, "x", 3, None) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, texts):  # noqa: F811
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# periodic runs


def plain_runs(w, least=24, exponent=3):
    """All maximal stretches of every period, the smallest period of each."""
    n, out = len(w), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, exponent * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return [[s, size, p] for (s, size), p in sorted(out.items(), key=lambda x: (x[0][0], x[1]))]


def periodic_words(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        block = [rng.randint(0, rng.choice((1, 3, 30))) for _ in range(rng.randint(1, 12))]
        w += (block * rng.randint(1, 30))[: rng.randint(1, 200)] + [rng.randint(0, 9) for _ in range(rng.randint(0, 20))]
    return np.array(w, np.int64)


def test_cover_has_every_difference():
    cover = periodic.COVER
    assert {(a - b) % periodic.MODULUS for a in cover for b in cover} == set(range(periodic.MODULUS))
    i, j = np.divmod(np.arange(periodic.MODULUS**2), periodic.MODULUS)
    for x in (i, j):
        assert np.isin((x + periodic.STEPS[i, j]) % periodic.MODULUS, cover).all()


def test_extensions_by_hand():
    rng = random.Random(1)
    for _ in range(40):
        w = periodic_words(rng)
        n = len(w)
        if n < 2:
            continue
        i, j = (np.array(x) for x in zip(*[rng.sample(range(n), 2) for _ in range(200)]))
        want = [next((t for t in range(n) if max(a, b) + t >= n or w[a + t] != w[b + t]), n) for a, b in zip(i, j)]
        assert periodic.Extensions(w).between(i, j).tolist() == want


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_runs_by_hand(monkeypatch, part):
    monkeypatch.setattr(periodic, "SLICE", part)
    rng = random.Random(part)
    for k in range(150):
        w = periodic_words(rng)[: 60 if part == 7 else 2000]
        least, exponent = ((24, 3), (6, 2), (2, 4))[k % 3]
        assert periodic.runs(w, least, exponent).tolist() == plain_runs(w.tolist(), least, exponent)
    assert periodic.runs(np.zeros(50_000, np.int64)).tolist() == [[0, 50_000, 1]]
    assert periodic.runs(np.arange(50_000) % 16_000).tolist() == [[0, 50_000, 16_000]]


def test_runs_of_documents(spark, odd):  # noqa: F811
    rng = random.Random(3)
    texts = [" ".join(f"t{x}" for x in periodic_words(rng)) for _ in range(60)]
    for r in periodic.find(table(spark, texts)).collect():
        w = texts[r["doc_id"]].split()
        found = plain_runs(w)
        gone = {i for s, size, p in found for i in range(s + p, s + size)}
        assert [list(x) for x in r["runs"]] == found and r["n_words"] == len(w)
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    out = periodic.find(odd).withColumn("best", periodic.strongest()).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], len(r["runs"])) for r in out) == sorted(
        (i or 0, len((t or "").encode().split()), int(t == "é " * 200)) for i, t in ODD
    )
    assert {r["best"] and tuple(r["best"]) for r in out} == {None, (0, 200, 1)}
    assert periodic.find(odd.limit(0)).count() == 0


def test_strongest_run_and_its_ties(spark):  # noqa: F811
    rows = [([(0, 30, 10), (50, 24, 8), (90, 31, 10), (95, 62, 20)],), ([(5, 24, 8), (5, 30, 10)],), ([],)]
    df = spark.createDataFrame(rows, f"runs {periodic.RUNS}").select(periodic.strongest().alias("b"))
    assert [r["b"] and tuple(r["b"]) for r in df.collect()] == [(90, 31, 10), (5, 24, 8), None]


def test_planted_runs(spark):  # noqa: F811
    texts = [" ".join(f"t{i}_{k}" for k in range(i * 7 % 90)) for i in range(300)] + [None]
    got = {r["doc_id"]: r["text"] for r in queries._planted(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        w = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        assert got[i].split() == w


# repeated passages


def plain_repeats(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    gone = []
    for w in split:
        gone.append({i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)})
    return split, gone


def passages(rng, vocabulary, n):
    base = [[f"v{rng.randrange(vocabulary)}" for _ in range(rng.choice((30, 90, 400)))] for _ in range(6)]
    out = []
    for i in range(n):
        w = [f"v{rng.randrange(vocabulary)}" for _ in range(rng.choice((0, 5, 40, 200)))]
        for _ in range(rng.choice((0, 1, 2))):
            b = rng.choice(base)
            lo = rng.randrange(len(b))
            w += b[lo : lo + rng.randint(1, 300)] + [f"u{i}_{k}" for k in range(rng.choice((0, 3)))]
        if rng.random() < 0.1:
            w += ["run"] * rng.randint(1, 150)
        if rng.random() < 0.1:
            w += ["a", "b", "c"] * rng.randint(1, 60)
        out.append(" ".join(w))
    return out + [out[0], out[1], out[1]]


@pytest.mark.parametrize("window, vocabulary", [(35, 5000), (35, 2), (8, 300), (1, 400), (80, 9)])
def test_repeats_by_hand(spark, window, vocabulary):  # noqa: F811
    texts = passages(random.Random(window * vocabulary), vocabulary, 60)
    split, gone = plain_repeats(texts, window)
    df = table(spark, texts)
    for r in recompress.mark(df, window).collect():
        w, lost = split[r["doc_id"]], gone[r["doc_id"]]
        assert {i for s in r["spans"] for i in range(s["start"], s["end"])} == lost
        kept = b" ".join(x for i, x in enumerate(w) if i not in lost)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(lost), sha256(kept).hexdigest())


def test_symbols_depend_on_their_context_alone():
    rng = random.Random(6)
    passage = [rng.randrange(1 << 60) for _ in range(12)] * 2 + [rng.randrange(1 << 60) for _ in range(300)] + [7] * 40 + [8, 9] * 30
    inside = []
    for k in range(4):
        before, after = ([rng.randrange(1 << 60) for _ in range(rng.randint(0, 50))] for _ in range(2))
        s = recompress.Symbols(np.array(before + passage + after, np.uint64), np.array([len(before) + len(passage) + len(after)])).until(4)
        own = (s.first >= len(before)) & (s.last <= len(before) + len(passage))
        inside.append({(n, a - len(before), b - len(before)) for n, a, b, f, e in zip(s.name, s.start, s.end, s.first, s.last) if f >= len(before) and e <= len(before) + len(passage)})
        assert own.sum() > 40
    assert inside[0] == inside[1] == inside[2] == inside[3]
    s = recompress.Symbols(np.array([5, 5, 6, 7], np.uint64), np.array([2, 0, 2])).until(3)
    assert set(s.text) == {0, 2} and s.end[s.text == 0].max() == 2


def test_high_symbols_speak_for_one_another(spark):  # noqa: F811
    rng = random.Random(2)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join([f"x{i}"] + shared + [f"y{i}"]) for i in range(12)] + [" ".join(shared[100:160]), " ".join(shared[500:534])]
    df = recompress.bounded_batches(table(spark, texts))
    once = recompress._once(recompress._low_names(df, 35), ["name"], recompress.KEY, F.count(F.lit(1)))
    _, known = recompress._known(recompress._screened(df, once, 35))
    named = recompress._window_names(known, 35)
    assert named.count() < 0.7 * 12 * 2966 and named.filter("weight = 2").count() > 1000
    got = {r["doc_id"]: r["n_removed"] for r in recompress.mark(table(spark, texts)).collect()}
    assert got == {**dict.fromkeys(range(12), 3000), 12: 60, 13: 0}


def test_repeats_of_odd_rows(spark, odd, monkeypatch):  # noqa: F811
    out = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in recompress.mark(odd).collect()]
    sizes = {5: 30_000, 6: 30_000, 9: 60_001}
    assert Counter(out) == Counter((i, n := sizes.get(i, len((t or "").encode().split())), n - (i == 9) if i in sizes or n == 200 else 0) for i, t in ODD)
    assert recompress.mark(odd.limit(0)).count() == 0 and recompress.cut(odd.limit(0)).columns == odd.columns
    cut = recompress.cut(odd)
    assert cut.columns == odd.columns and {r["text"] for r in cut.filter("doc_id IN (5, 6, 9)").collect()} == {"", "end"}
    assert sorted(r["text"] or "-" for r in cut.filter("doc_id IN (1, 2, 3, 4, 7, 8)").collect()) == sorted(t or "-" for i, t in ODD if i in (1, 2, 3, 4, 7, 8))
    assert {tuple(r)[2:] for r in cut.collect()} == {("clash", 0.5, 1, "x", 3, None)}


def test_slices_of_bytes():
    texts = [b"x" * n for n in (0, 5, 300, 2, 2, 90, 0)]
    for size in (1, 50, 10**6):
        got = list(words.byte_slices(texts, size))
        assert [k for i, j in got for k in range(i, j)] == list(range(len(texts)))
    assert list(words.byte_slices([], 5)) == []


# importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, lo, hi):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("lo, hi, size", [(1, 1, 1 << 20), (1, 2, 40), (2, 3, 1 << 20), (1, 1, 1)])
def test_features_by_hand(lo, hi, size):
    rng = random.Random(size + hi)
    texts = ["".join(rng.choices("abAB01 .,é漢\x00\n-", k=rng.randint(0, 60))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    for i, j in words.byte_slices(raw, size):
        n, owner, marks = resample.features(raw[i:j], words.Remembered(zlib.crc32), lo, hi, 97)
        for k in range(i, j):
            count, found = plain_features(texts[k], lo, hi)
            assert n[k - i] == count and Counter(marks[owner == k - i].tolist()) == Counter(zlib.crc32(f.encode()) % 97 for f in found)


@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2)])
def test_resampling_by_hand(spark, lo, hi):  # noqa: F811
    rng = random.Random(4)
    make = lambda pool, n: [" ".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(n)]
    plain, wanted = [f"p{i}" for i in range(300)], [f"t{i}" for i in range(50)]
    texts, target = make(plain, 300) + make(plain + wanted * 4, 100), make(wanted, 20)
    count = lambda xs: Counter(zlib.crc32(f.encode()) % 997 for x in xs for f in plain_features(x, lo, hi)[1])
    raw, good = count(texts), count(target)
    s_all, t_all = sum(raw.values()) + 997, sum(good.values()) + 997
    gain = [math.floor(1000 * math.log((good[b] + 1) * s_all / ((raw[b] + 1) * t_all))) for b in range(997)]
    df = table(spark, texts)
    got = resample.gains(*(resample.bucket_counts(x, lo, hi, 997) for x in (df, table(spark, target))))
    assert got.tolist() == gain
    want = {}
    for i, text in enumerate(texts):
        n, found = plain_features(text, lo, hi)
        weight = sum(gain[zlib.crc32(f.encode()) % 997] for f in found) // max(1, len(found))
        h = int(sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want[i] = [n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))]
    able = sorted((-row[3], i) for i, row in want.items() if row[0] >= 20)
    rank = {i: k + 1 for k, (_, i) in enumerate(able[: 10 * len(able) // 100])}
    rows = {r["doc_id"]: r for r in resample.draw(resample.score(df, got, lo, hi)).collect()}
    assert len(rank) > 10 and {i: [*r[1:]] for i, r in rows.items()} == {i: [*row, rank.get(i)] for i, row in want.items()}
    assert np.mean([want[i][2] for i in rank]) > np.mean([row[2] for row in want.values()])


def test_resampling_of_odd_rows(spark, odd):  # noqa: F811
    empty = odd.limit(0)
    rows = resample.resample(odd, empty, percent=100, least_words=0).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(ODD) + 1)) and {r["n_features"] for r in rows if r["doc_id"] in (1, 2, 4)} == {0}
    best = sorted(rows, key=lambda r: r["rank"])
    assert best == sorted(rows, key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0, r["rank"]))
    assert {r["n_words"] for r in rows if r["doc_id"] == 8} == {5}
    assert all(r["rank"] is None for r in resample.resample(odd, odd, percent=10).collect())  # 10 % of so few rows is none
    assert resample.resample(empty, odd).count() == 0 and resample.resample(empty, empty).count() == 0


def test_hot_score_is_ranked_whole(spark):  # noqa: F811
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(30).cast("long").alias("n_features"), F.lit(1).cast("long").alias("weight"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 9).cast("long").alias("score"))
    got = resample.draw(rows, percent=90).collect()
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 2701)) and len(got) == 3000
    keys = [(-r["score"], r["doc_id"]) for r in ranked]
    assert keys == sorted(keys)
