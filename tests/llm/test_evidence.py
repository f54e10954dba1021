"""Learned operators against plain versions of the same method: dense ridge, word and n-gram dictionaries, sums over all labellings."""

import itertools
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SF_DIR, spark  # noqa: E402, F401

from tidemark.llm import langid, pii, quality_classifier  # noqa: E402

BIG = f"{Path(SF_DIR).parent}/sf0.01"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_scores_are_those_of_dense_ridge(spark):  # noqa: F811
    q = quality_classifier
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    y = {r["doc_id"]: float(r["quality"] == 1) for r in spark.read.parquet(f"{BIG}/labels.parquet").collect() if r["quality"] is not None}
    got = {r["doc_id"]: r["score"] for r in q.classify(spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")).collect()}
    ids = sorted(texts)
    x = dict(zip(ids, np.array([q.statistics(texts[i]) for i in ids])))
    learn, check = ([i for i in ids if i in y and fold(i) in folds] for folds in ((1, 2, 3), (4,)))
    a = np.array([x[i] for i in learn])
    mean, scale = a.mean(axis=0), a.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1)
    rng = np.random.RandomState(q.SEED)
    omega, phase = rng.standard_normal((q.STATS, q.DIM)) / np.sqrt(q.STATS), rng.uniform(0, 2 * np.pi, q.DIM)
    bend = lambda m: np.hstack([np.sqrt(2 / q.DIM) * np.cos(np.clip((m - mean) / scale, -q.CLIP, q.CLIP) @ omega + phase), np.ones((len(m), 1))])
    z = bend(a)
    penalty = q.RIDGE * len(a) / q.DIM
    stacked = np.vstack([z, np.sqrt(penalty) * np.eye(q.DIM + 1)])  # ridge as least squares with added rows
    beta = np.linalg.lstsq(stacked, np.concatenate([[y[i] for i in learn], np.zeros(q.DIM + 1)]), rcond=None)[0]
    raw = np.clip(bend(np.array([x[i] for i in check])) @ beta, -1, 2)
    bins = defaultdict(list)
    for value, i in zip(raw, check):
        bins[math.floor(value * q.BINS)].append((value, y[i]))
    parts = [np.array(bins[b]) for b in sorted(bins)]
    rate, size, at = (np.array([f(p) for p in parts]) for f in (lambda p: p[:, 1].mean(), len, lambda p: p[:, 0].mean()))
    mean_of = lambda i, j: np.average(rate[i : j + 1], weights=size[i : j + 1])
    level = [max(min(mean_of(i, j) for j in range(k, len(rate))) for i in range(k + 1)) for k in range(len(rate))]  # isotonic by its min-max formula
    knots = [(np.average(at[own], weights=size[own]), v) for v in sorted(set(np.round(level, 12))) for own in [np.isclose(level, v)]]
    want = np.clip(np.interp(bend(np.array([x[i] for i in ids])) @ beta, *zip(*knots)), 0, 1)
    assert np.allclose([got[i] for i in ids], want, atol=1e-5)
    held = [i for i in ids if i in y and fold(i) == 0]
    good, bad = ([got[i] for i in held if y[i] == v] for v in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95  # area under the curve


@pytest.mark.parametrize("noise", [0, 1])
def test_languages_are_those_of_plain_dictionaries(spark, noise):  # noqa: F811
    rows = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", "lang").collect()
    model = langid.fit(spark.read.parquet(f"{BIG}/documents.parquet"))
    seen = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and fold(r["doc_id"]) != 0:
            for word in langid.letter_words(r["text"]):
                seen[r["lang"], 0][word] += 1
                for n in range(1, langid.LONGEST + 1):
                    for k in range(len(word) + 3 - n):
                        seen[r["lang"], n][f" {word} "[k : k + n]] += 1
    langs = sorted({lang for lang, _ in seen})
    total = {key: sum(c.values()) for key, c in seen.items()}
    kept = {}
    for (lang, n), counts in seen.items():
        most, by_count = (langid.WORDS if n == 0 else langid.GRAMS), Counter(counts.values())
        upto, least = 0, math.inf
        for c in sorted(by_count, reverse=True):
            upto += by_count[c]
            if upto > most:
                break
            least = c
        kept[lang, n] = {g: math.log(c / total[lang, n]) for g, c in counts.items() if c >= least}
    floor = [-math.log(max(total[lang, n] for lang in langs)) - 1 for n in range(langid.LONGEST + 1)]
    vector = lambda n, g: [kept[lang, n].get(g, floor[n]) for lang in langs] if any(g in kept[lang, n] for lang in langs) else None

    def word_scores(word):
        found = vector(0, word)
        for n in range(langid.LONGEST, 0, -1):
            if found is None:
                known = [v for k in range(len(word) + 3 - n) if (v := vector(n, f" {word} "[k : k + n])) is not None]
                found = np.mean(known, axis=0) if known else None
        return np.zeros(len(langs)) if found is None else np.array(found)

    rng = random.Random(noise)
    scorer = langid.Scorer(model)
    right = 0
    held = [r for r in rows if fold(r["doc_id"]) == 0 and r["text"] and r["lang"]][:120]
    for r in held:
        words = r["text"].split()
        text = " ".join(words[:400])
        if noise:  # a few words, one in four with a letter changed
            words = rng.sample(words, min(6, len(words)))
            text = " ".join(w[: (k := rng.randrange(len(w)))] + "x" + w[k + 1 :] if rng.random() < 0.25 else w for w in words)
        found = langid.letter_words(text)
        lang, score = scorer.predict(text)
        if not found:
            assert (lang, score) == (langid.UNKNOWN, 0.0)
            continue
        mean = np.mean([word_scores(w) for w in found], axis=0)
        p = np.exp((mean - mean.max()) * min(len(found), langid.EVIDENCE))
        assert score == pytest.approx(p.max() / p.sum(), abs=1e-9) and lang == langs[int(mean.argmax())]
        right += lang == r["lang"]
    assert right / len(held) > (0.9 if noise else 0.97)


def exact_marginals(potentials, field):
    """Label probabilities of each token by the sum over all labellings of tokens and values."""
    n, size = len(field.at), pii.OTHER + 1
    unary = potentials.prior + sum(potentials.odds[t][field.features[t]] for t in range(pii.TEMPLATES))
    total = np.zeros((n, size))
    for labels in itertools.product(range(size), repeat=n + field.values):
        if any(b != pii.OTHER and labels[i] != b for i, b in enumerate(field.base)):
            continue
        s = sum(unary[i, labels[i]] for i in range(n))
        s += sum(potentials.pairs[0][labels[i], labels[j]] for i, j in field.chain)
        s += sum(potentials.pairs[1][labels[n + v], labels[i]] for v, i in field.members)
        for i in range(n):
            total[i, labels[i]] += math.exp(s)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("text, loops", [
    ("a 12 b 345 c 67x", False), ("at 12 345 67 8", False), ("id 7654321 and 7654321 or 7654321", False), ("x 12 7654321 y 7654321 99", False),
    ("+12223334444 then 12223334444 z 5", False), ("on 222 333 4444 and 222 333 4444", True),
])
def test_beliefs_are_exact_marginals(text, loops):
    field = pii.Field(text, pii.base_spans(text))
    assert 3 <= len(field.at) <= 6
    for seed in range(3):
        rng = np.random.RandomState(seed)
        potentials = pii.Potentials({(0, 1, pii.OTHER): 1})
        potentials.prior = rng.randn(pii.OTHER + 1)
        potentials.odds = rng.randn(*potentials.odds.shape)
        potentials.pairs = rng.randn(*potentials.pairs.shape) * (0.4 if loops else 1.5)
        got, want = potentials.beliefs(field), exact_marginals(potentials, field)
        assert np.allclose(got, want, atol=0.08 if loops else 1e-3)
