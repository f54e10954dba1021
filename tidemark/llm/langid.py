"""Language identification by word-first backoff.

A known word scores the log of its relative frequency in each language. An unseen word falls back to its character
n-grams (with word borders), longest first: the first length of which any n-gram is known gives their mean. What one
language has and another lacks scores a floor that all languages share (below the rarest in the largest of them, so that a
language with little text is not favoured where it knows nothing). A text's score is the mean over its words.

The tables are learned from about ``SAMPLE_ROWS`` labelled texts outside fold 0, chosen by hash, all texts of rare
languages among them (the others share the rest evenly), and hold per language
most frequent words and n-grams of each length, up to ``WORDS`` and ``GRAMS`` (a count whose words do not all fit is left
out); frequencies are relative to all counts. So the model has a bounded size and is broadcast, and prediction is one pass without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text when nothing
could be learned; ties go to the language that sorts first; rows are never merged.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import bounded_batches, fold, hash_sample_by
from tidemark.session import cut_lineage

SAMPLE_ROWS = 20_000
WORDS = 20_000
GRAMS = 5_000
LONGEST = 4
EVIDENCE = 20
CACHE = 100_000
RARE = 10**9
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    found = LETTERS.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def grams(word: str, n: int) -> list[str]:
    framed = f" {word} "
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


class Model:
    """Log frequencies per language: a matrix row per known word, a tuple per n-gram (by length)."""

    def __init__(self, rows: list[tuple[str, int, str, float]], totals: dict[tuple[str, int], int]):
        self.langs = sorted({r[0] for r in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        largest = [max((c for (_, m), c in totals.items() if m == n), default=RARE) for n in range(LONGEST + 1)]
        floor = [[-math.log(c) - 1] * len(self.langs) for c in largest]
        tables: list[dict[str, list[float]]] = [{} for _ in range(LONGEST + 1)]
        for lang, n, gram, log in rows:
            tables[n].setdefault(gram, floor[n].copy())[place[lang]] = log
        self.words = {word: i for i, word in enumerate(tables[0])}
        self.word_rows = np.array([*tables[0].values()], np.float64).reshape(len(self.words), len(self.langs))
        self.grams = [{gram: tuple(v) for gram, v in table.items()} for table in tables[1:]]

    @classmethod
    def of(cls, state: dict) -> Model:
        """The model whose ``vars`` these are: plain lists, dicts and arrays, which any worker can read."""
        model = cls.__new__(cls)
        vars(model).update(state)
        return model

    def unseen(self, word: str) -> list[float]:
        """Mean of the longest known n-grams of a word that is not in the table."""
        framed = f" {word} "
        for n in range(min(LONGEST, len(framed)), 0, -1):
            get = self.grams[n - 1].get
            known = [v for i in range(len(framed) - n + 1) if (v := get(framed[i : i + n])) is not None]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * len(self.langs)


class Scorer:
    """Predicts texts; keeps the vectors of unseen words, and forgets them when there are too many."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = np.vstack([model.word_rows, np.zeros((1024, len(model.langs)))])
        scorer = self

        class Index(dict):
            def __missing__(self, word):
                i = self[word] = len(self)
                if i >= len(scorer.rows):
                    scorer.rows = np.vstack([scorer.rows, np.zeros_like(scorer.rows)])
                scorer.rows[i] = scorer.model.unseen(word)
                return i

        self.index = Index(model.words)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = letter_words(text)
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.index) > len(self.model.words) + CACHE:
            self.index.clear()
            self.index.update(self.model.words)
        at = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        mean = self.rows[at].mean(axis=0)
        p = np.exp((mean - mean.max()) * min(len(found), EVIDENCE))
        best = int(mean.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the texts with a language outside fold 0."""
    rows = bounded_batches(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    rows = hash_sample_by(rows, "lang", "doc_id", sample_rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(pdf["lang"], pdf["text"]):
                seen[lang].update(letter_words(text))
            for lang, found in seen.items():
                parts = {0: found, **{n: Counter() for n in range(1, LONGEST + 1)}}
                for word, c in found.items():
                    for n in range(1, LONGEST + 1):
                        for g in grams(word, n):
                            parts[n][g] += c
                for n, c in parts.items():
                    if not c:
                        continue
                    yield pd.DataFrame({"lang": lang, "n": n, "gram": list(c.keys()), "c": list(c.values())})

    counts = rows.select("lang", "text").mapInPandas(count, "lang string, n int, gram string, c long")
    counts = cut_lineage(counts.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")))
    totals = {(r["lang"], r["n"]): r["c"] for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    by_count = Window.partitionBy("lang", "n").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = counts.groupBy("lang", "n", "c").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(by_count))
    kept = sizes.filter(F.col("upto") <= F.when(F.col("n") == 0, WORDS).otherwise(GRAMS)).groupBy("lang", "n").agg(F.min("c").alias("least"))
    top = counts.join(F.broadcast(kept), ["lang", "n"])  # a row per language and length
    top = top.filter("c >= least")
    table = [tuple(r) for r in top.select("lang", "n", "gram", "c").collect()]
    return Model([(lang, n, gram, math.log(c / totals[lang, n])) for lang, n, gram, c in table], totals)


def identify(docs: DataFrame, model: Model | None = None, names: tuple[str, str] = ("__lang", "__score")) -> DataFrame:
    """Every row of ``docs`` with its language and score under ``names``, which must be free."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model or fit(docs)))
    lang, score = names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model.of(shared.value))
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, lang, score])

    kinds = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(work, kinds)


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per row of ``docs``."""
    model = fit(docs)
    rows = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
