"""Importance resampling of documents towards a target distribution of hashed word n-grams.

Batch concatenation: the texts of a batch are joined with a separator that no word can hold, one regex pass over the
joined bytes finds all words with their places, ``searchsorted`` of the places in the documents' offsets tells whose a
word is, runs of words whose ends belong to different documents are masked out, and ``bincount`` adds up what is left.

1. ``bucket_counts`` of all raw and of all target texts: tasks add whole partitions up to one number a bucket.
2. ``gains``: the log-likelihood ratio of a bucket, target against raw, in thousandths.
3. ``score``: the floored mean gain of a document's features plus a Gumbel number drawn from its id, so that the best
   scores are a sample without replacement whose odds follow the weights.
4. ``draw``: the best share of the documents. The cut is read off a histogram of the scores (whole numbers in a range
   that 64-bit counts bound to some 120 000 values); only rows from the cut on are sorted, by range, never in one task.

Memory of a task: a slice of a megabyte of text or one text, whichever is longer, and its places.

Defined results: a null or empty text has no words, weight 0 and a score like any other; a null ``doc_id`` counts as an
empty one in the draw of its Gumbel number and as the largest in ties; rows that repeat a ``doc_id`` are scored each by
its own text and, where all is equal, ranked in any order; without target texts all gains only reflect the raw counts;
empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Remembered, bounded_batches, byte_slices, text_of
from tidemark.operators.windows import global_index
from tidemark.session import cut_lineage

BUCKETS = 10_000
SHORTEST, LONGEST = 1, 1  # words of a feature
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATOR = b"\x00"


def features(texts: list[bytes], checksums: dict, shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and the text and bucket of every feature, from one pass over the joined texts."""
    joined = SEPARATOR.join(texts).lower()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes + 1) - sizes - 1
    places, sums, found = array("q"), array("q"), []
    for m in WORD.finditer(joined):
        word = m.group()
        places.append(m.start())
        sums.append(checksums[word])
        if longest > 1:
            found.append(word)
    owner = np.searchsorted(offsets, np.frombuffer(places, np.int64), side="right") - 1
    crc = np.frombuffer(sums, np.int64)
    owners, marks = [], []
    for n in range(1, longest + 1):
        if n > 1:
            rest = found[n - 1 :]
            crc = np.fromiter((zlib.crc32(w, zlib.crc32(b" ", c)) for w, c in zip(rest, crc.tolist())), np.int64, len(rest))
        if n >= shortest:
            own = owner[: len(crc)] == owner[n - 1 :]
            owners.append(owner[: len(crc)][own])
            marks.append(crc[own] % buckets)
    return np.bincount(owner, minlength=len(texts)), np.concatenate(owners), np.concatenate(marks)


def bucket_counts(df: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features of all texts of ``df`` in each bucket."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checksums, total = Remembered(zlib.crc32), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in byte_slices(texts):
                total += np.bincount(features(texts[i:j], checksums, shortest, longest, buckets)[2], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    rows = bounded_batches(df).select(text_of().cast("binary").alias("text")).mapInArrow(work, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, target to raw, floored."""
    b, s, t = len(raw), int(raw.sum()), int(target.sum())
    ratio = lambda x, y: ((y + 1) * (s + b)) / ((x + 1) * (t + b))
    return np.array([math.floor(1000 * math.log(ratio(x, y))) for x, y in zip(raw.tolist(), target.tolist())], np.int64)


def score(docs: DataFrame, gain: np.ndarray, shortest: int = SHORTEST, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    buckets = len(gain)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checksums = Remembered(zlib.crc32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns = [[], [], []]
            for i, j in byte_slices(texts):
                words, owner, marks = features(texts[i:j], checksums, shortest, longest, buckets)
                n = np.bincount(owner, minlength=j - i)
                total = np.zeros(j - i, np.int64)
                np.add.at(total, owner, shared.value[marks])
                for column, values in zip(columns, (words, n, total // np.maximum(n, 1))):
                    column.append(values)
            arrays = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bounded_batches(docs).select("doc_id", text_of().cast("binary").alias("text"))
    rows = rows.mapInArrow(work, f"doc_id {kind}, n_words long, n_features long, weight long")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + gumbel)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, … for the best ``percent`` of the rows of enough words, null for all others."""
    scored = cut_lineage(scored)
    able = F.col("n_words") >= least_words
    at = sorted(((r["score"], r["count"]) for r in scored.filter(able).groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in at) // 100
    cut, seen = None, 0
    for value, n in at:
        if seen >= wanted:
            break
        cut, seen = value, seen + n
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    best = scored.filter(able & (F.col("score") >= cut)).withColumns({"__down": -F.col("score"), "__last": F.col("doc_id").isNull(), "__any": F.rand(1)})
    ranked = global_index(best, ["__down", "__last", "doc_id", "n_features", "weight", "__any"], "rank").drop("__down", "__last", "__any")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < wanted, F.col("rank") + 1))
    rest = scored.filter(~able | (F.col("score") < cut)).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``, drawn towards the texts of ``target``."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return draw(score(docs, gain), percent, least_words)
