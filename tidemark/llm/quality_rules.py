"""Quality rules: base counts of a text, and a log-likelihood ratio of its hashed n-grams.

Tokens (runs of letters and digits, runs of other signs) give unigrams and bigrams, which are hashed
into ``BUCKETS`` buckets. One multinomial over the buckets is counted on all texts, the other on
trusted ones; both are smoothed by one. A text's score is the mean over its n-grams of
``log p_trusted - log p_raw``, so it does not depend on length, and every text is kept or dropped by
the same fixed threshold.

Everything is a Column expression. The corpus is read twice: counts are combined on the map side to at most
``BUCKETS`` rows a task, and the table of ``BUCKETS`` weights enters the second read as a constant. All trusted texts
are counted. Their ids are broadcast up to ``BROADCAST_IDS`` of them, a counted number; beyond it texts and ids are
joined by a shuffle, the only one.

Defined results: a null text counts as empty; without tokens the score is 0 (base rules then fail it);
without trusted texts all weights are 0 and only the base rules decide. Rows are never merged, so
repeated ids keep one result a row. Three-word windows are compared by hash: 64 bits less those that
number the words of the text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import text_of, words

TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
BUCKETS = 1 << 15
BROADCAST_IDS = 2_000_000
THRESHOLD = -0.5


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the trusted texts: all that are marked as good."""
    return labels.filter("quality = 1").select("doc_id").filter("doc_id IS NOT NULL").distinct()


def ngram_weights(docs: DataFrame, trusted: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> np.ndarray:
    """``log p_trusted - log p_raw`` of every bucket."""
    marked = trusted.select("doc_id", F.lit(1).alias("__y"))
    if marked.count() <= broadcast_ids:
        marked = F.broadcast(marked)
    rows = docs.select("doc_id", text_of().alias("__text")).join(marked, "doc_id", "left").withColumn("__t", _tokens(F.col("__text")))
    pairs = rows.select("__y", F.inline(F.arrays_zip(F.col("__t").alias("a"), F.slice("__t", 2, F.size("__t")).alias("b"))))
    one, two = _bucket(F.col("a")), _bucket(F.col("a"), F.col("b"))
    grams = pairs.select("__y", F.explode(F.when(F.col("b").isNull(), F.array(one)).otherwise(F.array(one, two))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("__y").alias("good"))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # at most BUCKETS rows
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.any():
        return np.zeros(BUCKETS)
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _repeat_words(windows: str, bits: str) -> Column:
    """Words in windows found more than once, from sorted ``hash << bits | position`` values."""
    w = F.col(windows)
    same = lambda x, y: F.coalesce(F.call_function("shiftright", x, F.col(bits)) == F.call_function("shiftright", y, F.col(bits)), F.lit(False))
    twice = F.filter(w, lambda x, i: same(x, F.get(w, i + 1)) | same(x, F.get(w, i - 1)))
    return F.transform(twice, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(bits)) - 1))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` with the base counts, ``base_failed``, ``llr`` and ``kept``, one row per row of ``docs``."""
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", text_of().alias("__text"))
    rows = rows.withColumns({"__w": words(text), "__t": _tokens(text), "__lines": lines})
    rows = rows.withColumn("n_words", F.size("__w").cast("bigint"))
    rows = rows.withColumn("__bits", F.length(F.bin("n_words")))
    w, bits = F.col("__w"), F.col("__bits")
    window = lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("bigint"))
    rows = rows.withColumn("__win", F.sort_array(F.slice(F.transform(w, window), 1, F.greatest(F.size(w) - 2, F.lit(0)))))
    table, t = F.split(F.lit(",".join(map(repr, weights.tolist()))), ",").cast("array<double>"), F.col("__t")  # folded to a constant
    both = lambda x, i: F.get(table, _bucket(x)) + F.when(i + 1 < F.size(t), F.get(table, _bucket(x, F.get(t, i + 1)))).otherwise(0.0)
    total = F.aggregate(F.transform(t, both), F.lit(0.0), lambda a, x: a + x)
    rows = rows.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words("__win", "__bits").alias("__twice"),
        F.when(F.size(t) > 0, total / (2 * F.size(t) - 1)).otherwise(0.0).alias("llr"),
    )
    covered = F.array_distinct(F.flatten(F.transform("__twice", lambda p: F.array(p, p + 1, p + 2))))
    rows = rows.withColumn("n_repeat_words", F.size(covered).cast("bigint"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr",
    )
