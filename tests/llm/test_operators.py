"""Operators for training data against brute force, round trips and held-out accuracy, on small and odd input."""

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SF_DIR, spark  # noqa: E402, F401

from tidemark.llm import bitslice, bpe, chat, langid, licenses, mixing, ngram_join, pii, quality_classifier, quality_rules  # noqa: E402
from tidemark.llm.words import hash_sample_by  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [
    (1, None, None, None, None, 0.5, "x"), (2, "", "en", "a", 0, None, None), (3, "one", "en", "b", 3, None, None),
    (4, " \n\t ", "de", "a", 4, None, None), (5, LONG, "en", "a", len(LONG), None, None), (6, LONG + " end", "fr", None, 1, None, None),
    (7, "one", "en", "b", 3, None, None), (7, "one", "en", "b", 3, None, None), (None, "mail me: x.y@z.org now", "en", "c", 1, None, None),
    (8, "é漢字 +1 (726) 555-9331 4913187196670932 10.0.0.1", "es", "c", 1, None, None),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):  # noqa: F811
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):  # noqa: F811
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):  # noqa: F811
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_rules_by_hand(docs, labels, odd):
    both = [(r["doc_id"], r["text"]) for r in docs.collect()]
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    token = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
    bucket = lambda *t: np.int64(np.uint64(_chain(t))) % quality_rules.BUCKETS
    raw, good = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    grams = {}
    for i, text in both:
        t = token.findall(text or "")
        grams[i] = [bucket(x) for x in t] + [bucket(x, y) for x, y in zip(t, t[1:])]
        np.add.at(raw, grams[i], 1)
        if i in trusted:
            np.add.at(good, grams[i], 1)
    b = quality_rules.BUCKETS
    want = np.log((good + 1) / (good.sum() + b)) - np.log((raw + 1) / (raw.sum() + b))
    weights = quality_rules.ngram_weights(docs, quality_rules.trusted_ids(labels))
    assert np.allclose(weights, want)
    for r in quality_rules.score(docs, weights).collect():
        text = dict(both)[r["doc_id"]] or ""
        w = WORD.findall(text)
        wins = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if wins[x] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        g = grams[r["doc_id"]]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(hit))
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        llr = float(np.mean(want[g])) if g else 0.0
        assert r["llr"] == pytest.approx(llr, abs=1e-9)
        assert r["base_failed"] == failed and r["kept"] == (not failed and llr >= quality_rules.THRESHOLD)
    out = quality_rules.score(odd, np.zeros(b)).collect()
    assert len(out) == len(ODD) and {r["n_words"] for r in out if r["doc_id"] in (1, 2, 4)} == {0}
    assert quality_rules.score(odd.limit(0), np.zeros(b)).count() == 0


def _chain(tokens) -> int:
    """Hash of several texts in turn, each seeded with the hash before."""
    h = 42
    for t in tokens:
        h = xxhash.xxh64_intdigest(t.encode(), seed=h)
    return h


def test_rules_without_trust(docs, labels):
    assert not quality_rules.ngram_weights(docs, quality_rules.trusted_ids(labels.limit(0))).any()
    trusted = quality_rules.trusted_ids(labels)
    assert (quality_rules.ngram_weights(docs, trusted) == quality_rules.ngram_weights(docs, trusted, broadcast_ids=0)).all()


def _components(texts: dict, percent=85):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    ids = sorted(sets)
    links = {i: [j for j in ids if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in ids}
    name = {}
    for i in ids:
        if i not in name:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in name:
                    name[k] = i
                    todo += links[k]
    return {i: (len(sets[i]), name[i], len(links[i])) for i in ids}


@pytest.mark.parametrize("block", [3, 512])
def test_join_by_hand(spark, block):  # noqa: F811
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(rng.choice((6, 40, 150)))) for _ in range(25)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {}
    for i in range(220):
        w = base[i % 25].split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 5))):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        texts[i] = " ".join(w) + (" " + passage if i % 3 == 0 else "")
    texts |= {900: None, 901: "", 902: "one two", 903: "ONE Two", 904: " \n "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.link(df, block=block, count_links=True).collect()}
    assert got == _components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df, block=block).collect()}
    assert got == {i: x[:2] for i, x in _components(texts).items()}


@pytest.mark.parametrize("sample, least, hot", [(1, 2, 10_000), (1, 40, 10_000), (2, 1, 5)])
def test_hot_tokens_change_no_link(spark, monkeypatch, sample, least, hot):  # noqa: F811
    for name, value in {"SAMPLE": sample, "LEAST_SEEN": least, "HOT_TOKENS": hot, "SALTS": 3}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = {i: " ".join(passage + [f"w{rng.randint(0, 3)}_{i % 40}_{j}" for j in range(rng.choice((1, 4, 40)))]) for i in range(160)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.link(df, block=16, count_links=True).collect()}
    assert got == _components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df, block=16).collect()}
    assert got == {i: x[:2] for i, x in _components(texts).items()}


def test_large_clusters_become_groups(spark, monkeypatch):  # noqa: F811
    monkeypatch.setattr(ngram_join, "PIECE", 2)
    rng = random.Random(9)
    texts = {}
    for i in range(240):  # a chain of versions, a cluster around one text, and texts near to it
        w = [f"{'ab'[i % 2]}{k}" for k in range(120)]
        if i % 2:
            for k in range(i // 8):
                w[4 * k % 120] = f"new{k}"
        else:
            w[rng.randrange(120)] = f"x{i}"
            if i % 20 == 0:
                w[:14] = [f"y{i}_{k}" for k in range(14)]
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = _components(texts)
    for block in (4, 16):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df, block=block).collect()}
        assert got == {i: x[:2] for i, x in want.items()}
    _, nodes = ngram_join._copies(df, 4, 85, True)
    active, read = ngram_join._blocks(df, nodes, 4, 85, 4)
    active, _ = ngram_join._contracted(active, read, 4, 85, 4)
    assert active.filter("`group` < 0").count() > 100
    assert ngram_join._visits(active, 85).count() < ngram_join._visits(active.withColumn("group", F.col("block")), 85).count() / 3


def test_a_common_passage_makes_few_visits(spark, monkeypatch):  # noqa: F811
    """Most of every text is one passage, the rest is shared by few texts: groups of the passage are not all visited."""
    made, tasks = [], ngram_join._tasks
    monkeypatch.setattr(ngram_join, "_tasks", lambda active, visits, alone: made.append(visits.count()) or tasks(active, visits, alone))
    passage, parts = [f"p{i}" for i in range(70)], [[f"q{k}_{i}" for i in range(10)] for k in range(163)]
    texts = {i: " ".join(passage + sum(parts[i : i + 4], [])) for i in range(160)} | {160 + i: " ".join(passage + sum(parts[i : i + 4], []) + [f"x{i}"]) for i in range(8)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df, block=8).collect()}
    assert got == {i: x[:2] for i, x in _components(texts).items()}
    assert made[0] <= 4 * len(texts)


def test_one_of_each_goes_by_text(spark):  # noqa: F811
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 0), (1, b, 1), (2, a, 2), (None, c, 3), (None, c + " end", 4), (None, c, 5), (3, None, 6), (3, None, 7), (None, " ", 8), (4, b + " z", 9), (4, b + " z", 10)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, t1 int, ROW string, id int, `__id` int, t2 int")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    out = kept.collect()
    got = Counter((r["doc_id"], r["text"]) for r in out)
    assert got[1, a] == 1 and got[1, b] == 1 and got[3, None] == 2 and got[None, " "] == 1 and sum(got.values()) == 6
    assert sum(n for (i, t), n in got.items() if i is None and t in (c, c + " end")) == 1
    assert all((r["doc_id"], r["text"], r["t1"]) in rows for r in out)


def test_one_of_each_moves_its_texts_once(spark):  # noqa: F811
    broad = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.one_of_each(spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string"))
        assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d e"), (2, None)]
        plan = kept._jdf.queryExecution().sparkPlan().toString(), kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broad)
    assert "SortMergeJoin" in plan[0]
    assert plan[1].count("Exchange hashpartitioning") == 5  # two for the labels, one for the first rows, one a side of the join


def test_join_odd_rows(odd):
    rows = [(r["doc_id"], r["component_id"]) for r in ngram_join.link(odd).collect()]
    assert len(rows) == len(ODD) and set(rows) >= {(1, 1), (5, 5), (6, 5), (7, 3), (None, None)}
    kept = ngram_join.one_of_each(odd).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([1, 2, 3, 4, 5, 8, None])
    assert ngram_join.link(odd.limit(0)).count() == 0


def test_one_id_with_two_texts(spark):  # noqa: F811
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(3, a), (3, b), (5, a + " z"), (6, b + " z"), (9, "c d e f")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.link(df).collect()} == {(3, 3), (5, 3), (6, 3), (9, 9)}


def test_classifier(spark, docs, labels, odd):  # noqa: F811
    big = spark.read.parquet(f"{Path(SF_DIR).parent}/sf0.01/documents.parquet")
    known = spark.read.parquet(f"{Path(SF_DIR).parent}/sf0.01/labels.parquet")
    rows = quality_classifier.classify(big, known).join(known, "doc_id").filter("held_out").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]) > 0.9
    out = quality_classifier.classify(odd, labels.limit(0)).collect()
    assert len(out) == len(ODD) and {r["score"] for r in out} == {0.5}
    assert quality_classifier.classify(odd.limit(0), labels).count() == 0
    stats = quality_classifier.features(odd)
    model = quality_classifier.fit(quality_classifier.features(docs), labels)
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.score(stats, model).collect())
    x, y = quality_classifier.pool(np.arange(4.0), np.array([0.0, 2, 1, 2]), np.full(4, 2.0))
    assert y.tolist() == [0, 0.75, 1]


def test_mixing(odd, docs, spark):  # noqa: F811
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 0.5) and sum(r["size"] for r in own) == own[0]["source_size"]
    assert mixing.mix(odd.limit(0)).count() == 0
    again = {tuple(r) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {tuple(r) for r in mixing.mix(docs).collect()}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 3
    assert mixing.repeated(odd.limit(0)).count() == 0 and set(mixing.repeated(odd).columns) == set(odd.columns)


def _licenses_plainly(text, templates=licenses.TEMPLATES):
    """All windows of all templates, none pruned."""
    grams = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:])]
    doc, found = grams(licenses.template_words(text or "")), []
    for name, said in templates:
        kept, span = set(licenses.template_bigrams(said)), len(licenses.template_words(said)) - 1
        for start in range(max(len(doc) - span, 0) + 1):
            window = set(doc[start : start + span])
            shared = len(window & kept)
            found.append((shared, 2.0 * shared / (len(window) + len(kept)), start, name))
    found = [f for f in found if f[1] >= 0.8]
    best = [f for f in found if f[:2] == max(found)[:2]]
    names = sorted({f[3] for f in best})
    return names[0] if len(names) == 1 else None, best[0][1] if best else 0.0, ",".join(names), min((f[2] for f in best), default=None)


def test_licenses(spark):  # noqa: F811
    gnu = licenses.GNU_NOTICE.format
    said = {
        "some prose comes first here\nReleased under the MIT license!\nand more of it after": ("MIT", "MIT", 5),
        "This project is licensed under the MIT License.": ("MIT", "MIT", 3),
        "a line of prose that was released under the\nMIT license long ago": ("MIT", "MIT", 6),
        "\n\nLicensed under the\nApache License, Version 2.0.\n\nz": ("Apache-2.0", "Apache-2.0", 0),
        "This work is licensed under the GNU General Public License, version 2.": ("GPL-2.0", "GPL-2.0", 0),
        "This work is licensed under the GNU General Public License, version 3.": ("GPL-3.0", "GPL-3.0", 0),
        gnu("This program", "Affero General Public License", "3"): ("AGPL-3.0", "AGPL-3.0", 0),
        gnu("Mill", "Lesser General Public License", "2.1"): ("LGPL-2.1", "LGPL-2.1", 0),
        "by us: " + licenses.BSD_GRANT: (None, "BSD-2-Clause,BSD-3-Clause", 2),
        "x y " + licenses.BSD_TWO + licenses.BSD_WARRANTY: ("BSD-2-Clause", "BSD-2-Clause", 2),
        "x " + licenses.BSD_TWO + licenses.BSD_NAMES + licenses.BSD_WARRANTY + " z": ("BSD-3-Clause", "BSD-3-Clause", 1),
        "Copyright us\n\n" + licenses.MIT_TEXT.replace(" ", "\n  "): ("MIT", "MIT", 2),
        licenses.ISC_GRANT + licenses.ISC_WARRANTY: ("ISC", "ISC", 0),
        "Released under the BSD thing": (None, "", None),
        "one": (None, "", None), "": (None, "", None), "  \n": (None, "", None), LONG: (None, "", None),
        LONG + " licensed under the MIT License " + LONG: ("MIT", "MIT", len(licenses.template_words(LONG))),
    }
    texts = [*said, None, "licensed under the MIT License"]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(4, texts[4], "x", 0), (None, texts[1], None, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, license string, __found int")  # noqa: F811
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 4 for r in got) == 2
    of = {r["doc_id"]: tuple(r)[1:] for r in got}
    for i, (text, (name, names, start)) in enumerate(said.items()):
        assert (of[i][0], of[i][2], of[i][3]) == (name, names, start), text[:60]
    assert of[None] == of[1] and of[len(said)] == (None, 0.0, "", None)
    empty = licenses.scan(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "license", "dice", "candidates", "start"]


def test_licenses_against_all_windows(spark):  # noqa: F811
    draw = random.Random(5)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(draw.randint(1, 3)):
            w = licenses.template_words(draw.choice(licenses.TEMPLATES)[1])
            w = w[draw.randint(0, len(w) // 4) : len(w) - draw.randint(0, len(w) // 4)]
            w = [x for x in w if draw.random() > 0.04]
            w = [draw.choice(("the", "license", "odd")) if draw.random() < 0.04 else x for x in w]
            parts += w + ["and", "so", "on"][: draw.randint(0, 3)]
        texts.append(" ".join(parts))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {i: _licenses_plainly(t) for i, t in enumerate(texts)}


def test_license_bounds():
    for b in range(1, 40):
        lo, hi = licenses.size_bounds(b, 0.8)
        assert all((2 * min(a, b) / (a + b) >= 0.8 - 1e-12) == (lo <= a <= hi) for a in range(1, 100))


def test_language(spark, odd, docs):  # noqa: F811
    big = spark.read.parquet(f"{Path(SF_DIR).parent}/sf0.01/documents.parquet").cache()
    rows = langid.predict(big).join(big.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    out = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd.unionByName(odd.limit(0))).collect() if r["doc_id"] in (1, 2, 4)}
    assert out == {1: "und", 2: "und", 4: "und"}
    assert langid.predict(odd.limit(0)).count() == 0
    digits = spark.createDataFrame([(1, "123 ½ !!", "en")], "doc_id long, text string, lang string")
    assert langid.predict(digits).first()["lang_pred"] == "und"
    assert set(langid.identify(odd).columns) == {*odd.columns, "__lang", "__score"}
    model = langid.Model([("de", 0, "und", -1.0), ("en", 0, "and", -1.0), ("de", 2, "sc", -2.0)], {("de", 0): 9, ("en", 0): 9, ("de", 2): 5})
    assert langid.Scorer(model).predict("und schon")[0] == "de" and langid.Scorer(model).predict("zzz")[0] == "de"


def test_language_scores_do_not_depend_on_what_was_seen(monkeypatch):
    rng = random.Random(4)
    rows = {(lang, n, "".join(rng.choices("abcde", k=n or 3))): -9 * rng.random() for lang in ("de", "en", "fr") for n in range(5) for _ in range(40)}
    model = langid.Model([(*key, log) for key, log in rows.items()], {(lang, n): 500 for lang in ("de", "en", "fr") for n in range(5)})
    texts = [" ".join("".join(rng.choices("abcdefé", k=rng.randint(1, 8))) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    fresh = [langid.Scorer(model).predict(t) for t in texts]
    kept = langid.Scorer(model)
    assert [kept.predict(t) for t in texts] == fresh and len(kept.index) > len(model.words) + 5
    monkeypatch.setattr(langid, "CACHE", 5)
    forgetful = langid.Scorer(model)
    assert [forgetful.predict(t) for t in texts] == fresh and len(forgetful.index) < len(kept.index)


@pytest.mark.parametrize("n_words", [3, 20, 200, 800])
def test_a_small_language_takes_no_texts_of_others(spark, n_words):  # noqa: F811
    rng = random.Random(n_words)
    tiny = ["".join(rng.choices("kqwxzauo", k=rng.randint(2, 9))) for _ in range(n_words)]
    known = spark.read.parquet(f"{Path(SF_DIR).parent}/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    ids = spark.range(10**7, 10**7 + 9).select(F.col("id").alias("doc_id")).filter(langid.fold(F.col("doc_id")) != 0).limit(1)
    model = langid.fit(known.unionByName(ids.select("doc_id", F.lit(" ".join(tiny)).alias("text"), F.lit("tiny").alias("lang"))))
    scorer = langid.Scorer(model)
    rows = known.filter(langid.fold(F.col("doc_id")) == 0).collect()
    assert np.mean([scorer.predict(r["text"])[0] == r["lang"] for r in rows]) > 0.97
    assert scorer.predict(" ".join(rng.choices(tiny, k=9)))[0] == "tiny"


def test_sample_keeps_rare_languages(spark):  # noqa: F811
    lang = F.when(F.col("doc_id") % 1000 == 0, "rare").when(F.col("doc_id") % 2 == 0, "a").otherwise("b")
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("lang", lang)
    got = {r["lang"]: r["count"] for r in hash_sample_by(rows, "lang", "doc_id", 2020).groupBy("lang").count().collect()}
    assert got["rare"] == 20 and all(850 < got[x] < 1150 for x in "ab")
    assert hash_sample_by(rows, "lang", "doc_id", 20_000).count() == 20_000


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda x: re.sub(r"[^0-9]", "", x)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans_by_hand(docs):
    rng = random.Random(3)
    signs = list("0123456789") * 2 + list("..@@+- ()aZ_%\n") + ["192.168.0.1", "4111 1111 1111 1111", "+1 (222) 333-4444", "a@b.co"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(4000)] + [r["text"] or "" for r in docs.collect()]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)
    assert pii.base_spans("a" * 200_000 + "9" * 200_000) == []


def test_pii_report(docs, odd):
    known = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.report(docs).collect():
        base = plain_spans(known[r["doc_id"]])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert set(said.split(",")) <= set(r["spans"].split(",")) or not said
    assert pii.report(odd).count() == len(ODD) and pii.report(odd.limit(0)).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.mask(odd).collect()}
    assert clean[None] == "mail me: <EMAIL> now" and clean[1] is None and "10.0.0.1" not in clean[8]


def test_skip_edges_carry_labels():
    text = "card 4111111111111111 then, once more 4111-1111-1111-1111x and +1 (222) 333-4444 or 222 333-4444"
    field = pii.Field(text, pii.base_spans(text))
    assert len(field.skip) == 2  # the card, and the end of the phone number
    counts = Counter({(0, int(b), int(y)): 50 for b, y in zip(field.features[0], field.base) if y != pii.OTHER})
    counts[pii.TEMPLATES + 1, 2, 2] = 100
    counts[0, 1, pii.OTHER] = 100
    belief = pii.Potentials(dict(counts)).beliefs(field)
    i, j = field.skip[0]
    assert belief[i].argmax() == 2 and belief[j][2] > belief[j][0]


def _neutral(text):
    """The field of a text, and potentials in which only edges speak."""
    field, potentials = pii.Field(text, pii.base_spans(text)), pii.Potentials({(0, 1, pii.OTHER): 1})
    potentials.prior[:], potentials.odds[:] = 0, 0
    potentials.pairs[:] = np.where(np.eye(pii.OTHER + 1) > 0, 3, -3)
    return field, potentials.beliefs(field)


def test_evidence_reaches_all_repeats():
    field, belief = _neutral("phone +12223334444" + " then 12223334444 again" * 300)
    assert field.base[0] == 3 and (field.base[1:] == pii.OTHER).all() and len(belief) == 301
    assert (belief[:, 3] >= pii.SURE).all() and len(field.members) == 301


def test_grouped_and_similar_numbers_share_evidence():
    text = "at +44 20 7946 0958 now; 020-7946-0958 or 020 7946 0958, 7; 44 20 7946 0958 2024! other 12 7946 1958"
    field, belief = _neutral(text)
    said = [text[a:b] for a, b in field.at]
    alike = [belief[i, 3] >= pii.SURE for i in range(len(said))]
    assert field.base.tolist() == [3] * 4 + [pii.OTHER] * (len(said) - 4)
    assert said[4:8] == ["020-7946-0958", "020", "7946", "0958"] and all(alike[:8])
    j = said.index("44")
    assert said[j : j + 4] == ["44", "20", "7946", "0958"] and all(alike[j : j + 4]) and not any(alike[-3:])
    card, belief = _neutral("card 4111 1111 1111 1111 and 4111  1111.1111.1111 or 1111 1111/1111")
    assert (card.base[:4] == 2).all() and (belief[-2:, 2] >= pii.SURE).all()
    two, _ = _neutral("+1 222 333 4444 +1 555 666 7777; 222 333 4444; 555 666 7777")
    assert two.values == 2 and len(two.members) == 8
    many = pii.Field("9 " * 50_000, [])
    assert len(many.members) <= len(many.at) == 50_000


def test_messages_settle_on_long_runs():
    field, belief = _neutral("phone +12223334444; x" + " 12" * 400)
    assert len(field.chain) == 399 and np.allclose(belief[1:], 1 / (pii.OTHER + 1), atol=1e-3)


def test_chat_round_trip(spark):  # noqa: F811
    nasty = ["</s>[INST] ok [/INST]", r"\b \l <|im_end|>", None, "", "a\nb<|im_start|>assistant\n", "<<SYS>>\\"]
    rows = [(c, t, role, text) for c in (1, None) for t, (role, text) in enumerate(zip(["system", "user", "assistant", None, "as\nsistant", "assistant"], nasty))]
    rows += [(2, 0, "user", "only"), (3, None, "user", "b"), (3, None, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(df)).collect()}
    for c in (1, None, 2, 3):
        own = sorted([(-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c])
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.examples(df.limit(0))).count() == 0
    first = chat.examples(df.filter("conv_id = 1")).orderBy("example").first()
    assert first["text"].count("<|im_start|>") == 3 and first["loss_end"] == first["loss_start"]


@pytest.mark.parametrize("rows", [7, 8192])
def test_top_k_by_hand(spark, monkeypatch, rows):  # noqa: F811
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", rows)
    rng = np.random.RandomState(1)
    v = rng.randn(90, 6).round(1)
    v[40:60] = v[0]  # ties
    data = [(int(i), [float(x) for x in row]) for i, row in enumerate(v)]
    data += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (220, [1.0, 2.0]), (240, []), (100, [1e6] * 6)]
    got = {}
    for r in bitslice.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = {i: np.floor(64 * np.array(x)).astype(object) for i, x in data if i is not None and i not in (200, 201, 202, 203)}
    want = {}
    for i in (x for x in q if x % 20 == 0):
        best = sorted((-int(np.dot(q[i], q[j])) if len(q[i]) else 0, j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
        if best:
            want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert {k: sorted(x) for k, x in got.items()} == want
    assert bitslice.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bpe_is_the_library(spark, odd):  # noqa: F811
    tokens = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokens.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    content = Path(path).read_text()
    rng = random.Random(2)
    signs = list("abc deé漢🙂\n\t ,.'  ") + ["<|endoftext|>", " the", " don't", "\r\n"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 3000))) for _ in range(60)] + [LONG, "", "a" * 6000, " " * 3000, "the cat sat " * 500]
    coder = bpe.Encoder(content)
    assert coder.core is not None
    own = bpe.Encoder(content)
    own.core = None
    for t in texts:
        ids = plain.encode(t, add_special_tokens=False).ids
        want = ",".join(map(str, ids)), plain.decode(ids, skip_special_tokens=False)
        assert coder.encode(t) == want and own.encode(t) == want
    out = bpe.encode(odd, path).collect()
    assert len(out) == len(ODD) and all(len(r["ids"]) == r["n_tokens"] for r in out)
    for r in out:
        text = next((x[1] or "" for x in ODD if x[0] == r["doc_id"]))
        ids = plain.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(odd.limit(0), path).count() == 0


def test_pipeline_rows(spark):  # noqa: F811
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF_DIR)
        assert state.columns == docs.columns, name
        rows = state.collect()
        if name == "language":
            assert {r["doc_id"] for r in rows} >= {i for i, t in texts.items() if t and len(t) > 200}
            left = {r["doc_id"]: r["text"] for r in rows}
        if name == "near_copies":
            by = _components(left)
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, (_, c, _) in by.items() if c == i)
        if name == "personal_data":
            assert not any(plain_spans(r["text"]) for r in rows)
    out = corpus_pipeline.STAGES[-1][1](spark, state, SF_DIR)
    assert out.count() == state.count() and out.filter("n_tokens <> size(ids)").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
    assert empty.count() == 0


CLASHES = [
    "lang_found", "LANG_SCORE", "__lang", "__score", "id", "t1", "t2", "row", "rep", "none", "f", "__id", "__turn", "of", "whole", "cut", "last", "copy", "more_of",
    "__s", "__c", "__copy", "__d", "n_tokens", "ids", "ids_sha256", "__spans", "node", "k1", "k2", "component", "left", "n_words", "size",
]


def test_pipeline_with_clashing_columns_and_shared_ids(spark):  # noqa: F811
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd_ids = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, 14).otherwise(F.col("doc_id"))
    docs = docs.withColumn("doc_id", odd_ids).unionByName(docs.limit(0)).withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
    texts, state = {r["text"] for r in docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = ngram_join.cut_lineage(stage(spark, state, SF_DIR))
        assert state.columns == docs.columns, name
        rows = state.collect()
        assert rows and all([r[c] for c in CLASHES] == list(range(len(CLASHES))) for r in rows), name
        if name == "language":
            left = sorted(r["text"] for r in rows)
        if name == "near_copies":
            by = _components(dict(enumerate(left)))
            kept = Counter(by[left.index(r["text"])][1] for r in rows)
            assert set(kept) == {c for _, c, _ in by.values()} and set(kept.values()) == {1} and {r["text"] for r in rows} <= texts
    out = corpus_pipeline.STAGES[-1][1](spark, state, SF_DIR)
    assert set(out.columns) == {*docs.columns, "_n_tokens", "_ids", "_ids_sha256", "decoded_sha256"} - {"text"}
    for r in out.collect():
        assert r["n_tokens"] == len(r["ids"]) and (r["_n_tokens"], r["_ids"]) == (CLASHES.index("n_tokens"), CLASHES.index("ids"))


def test_pipeline_counts_and_token_ids(spark):  # noqa: F811
    """The mixture's copies by a plain water-filling, and the ids by the library itself."""
    tokens = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in rows.items()}
    sources = sorted({r["source"] for r in rows.values()}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, r in rows.items() if r["source"] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    full = set()
    while True:
        rate = (sum(total.values()) - sum(3 * total[s] for s in full)) / max(1, sum(w for s, w in weight.items() if s not in full))
        over = {s for s in sources if s in full or weight[s] * rate > 3 * total[s]}
        if over == full:
            break
        full = over
    target = {s: 3 * total[s] if s in full else weight[s] * rate for s in sources}
    copies = Counter()
    for s in sources:
        quota = int(target[s] + 0.5)
        whole, left = divmod(quota, max(1, total[s]))
        own = sorted((hashlib.md5(f"mix-1|{i}".encode()).hexdigest(), i) for i, r in rows.items() if r["source"] == s)
        for _, i in own:
            copies[i] = whole + (left > 0 and 2 * left >= size[i])
            left -= min(left, size[i])
    got = corpus_pipeline.mixture(spark, docs, SF_DIR)
    assert Counter(r["doc_id"] for r in got.collect()) == +copies
    plain = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    for r in corpus_pipeline.token_ids(spark, docs, SF_DIR).collect():
        assert r["ids"] == plain.encode(rows[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
