"""Periodic runs of words: stretches that repeat a block of words, found on whole texts.

Longest common extensions (LCE) of two places of a text come from a difference cover: of the residues modulo ``MODULUS``
only those of ``COVER`` are sampled. Any two places reach sampled ones after the same few steps, which compare words;
from there on the answer is a range minimum over the sorted samples. Only the sampled suffixes are sorted: named by their
first ``MODULUS`` words, then by doubling along each residue class. The structure is built when a query first gets so far.

Runs are enumerated on a harmonic grid. A run of period q and at least 3 q words agrees with itself, q words on, over at
least 2 q consecutive places, which hold a multiple of 2 q. So the places 0, 2 q, 4 q, … of every period are enough: where
the words at ``i`` and ``i + q`` are equal, the LCE forward and backward gives the longest stretch of that period. What has
a smaller period is found at that period too, so each stretch keeps its smallest one.

Work of a text of n words: n ln n / 2 comparisons, in slices of ``SLICE`` grid places, plus sorting of the samples. Memory
of a task: some hundred bytes a word of its longest text.

Defined results: a null or empty text has no words and no runs; rows that repeat a ``doc_id`` are one result each; a null
``doc_id`` keeps its row; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import bounded_batches, text_of

LEAST_WORDS = 24
EXPONENT = 3
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)  # every difference modulo 31 is a difference of two of these
SLICE = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def _steps() -> np.ndarray:
    """For residues a and b, the fewest steps after which both are sampled."""
    sampled = np.isin(np.arange(MODULUS), COVER)
    r = np.arange(MODULUS)
    meet = sampled[(r[:, None, None] + r) % MODULUS] & sampled[(r[None, :, None] + r) % MODULUS]
    return meet.argmax(axis=2)


STEPS = _steps()


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Extensions:
    """Longest common extensions of places of one text, given as an array of word numbers from 0."""

    def __init__(self, words: np.ndarray):
        self.words = words.astype(np.int64)
        self.rank = None

    def _build(self) -> None:
        w, n = self.words, len(self.words)
        kinds = int(w.max()) + 2
        at = np.concatenate([np.arange(c, n, MODULUS) for c in COVER])  # class by class
        m = len(at)
        name = np.zeros(m, np.int64)
        for t in range(MODULUS):
            place = at + t
            name = _ranked(name * kinds + np.where(place < n, w[np.minimum(place, n - 1)] + 1, 0))
            if int(name.max()) + 1 == m:
                break
        last = np.append(np.flatnonzero(np.diff(at % MODULUS)), m - 1)
        follow = np.arange(1, m + 2)  # index m stands for the end of the text
        follow[last] = follow[m] = m
        levels = []
        while True:
            name = np.append(name, -1)
            levels.append((name, follow))
            if int(name.max()) + 1 == m:
                break
            name = _ranked((name[:m] + 1) * (m + 1) + name[follow[:m]] + 1)
            follow = follow[follow]
        order = np.argsort(levels[-1][0][:m])
        a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(m - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            names, follow = levels[k]
            same = (names[a] == names[b]) & (a < m)
            shared[same] += MODULUS << k
            a[same], b[same] = follow[a[same]], follow[b[same]]
        x, y = np.append(at, n)[a], np.append(at, n)[b]
        shared += self._compare(x, y, np.full(len(x), MODULUS))[0]
        self.table = [shared]
        while (1 << len(self.table)) <= len(shared):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))
        self.rank = np.full(n, -1, np.int64)
        self.rank[at[order]] = np.arange(m)

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from ``i`` and ``j`` on, at most ``most``, and whether all of them are equal."""
        w, n = self.words, len(self.words)
        found = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for t in range(int(most.max(initial=0))):
            live = live[most[live] > t]
            x, y = i[live] + t, j[live] + t
            inside = np.maximum(x, y) < n
            live, x, y = live[inside], x[inside], y[inside]
            live = live[w[x] == w[y]]
            if not len(live):
                break
            found[live] += 1
        return found, found == most

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from ``i`` and from ``j`` on, for arrays of different places."""
        n = len(self.words)
        steps = STEPS[i % MODULUS, j % MODULUS]
        found, whole = self._compare(i, j, steps)
        on = np.flatnonzero(whole & (np.maximum(i, j) + steps < n))
        if len(on):
            if self.rank is None:
                self._build()
            x, y = self.rank[i[on] + steps[on]], self.rank[j[on] + steps[on]]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp(hi - lo)[1] - 1  # the largest power of two that fits
            least = np.empty(len(on), np.int64)
            for k in np.unique(level):
                of = level == k
                least[of] = np.minimum(self.table[k][lo[of]], self.table[k][hi[of] - (1 << int(k))])
            found[on] += least
        return found


def _grid(n: int, longest: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the harmonic grid, a slice at a time."""
    first = 1
    while first <= longest:
        p = np.arange(first, min(longest, first + SLICE) + 1)
        count = (n - p - 1) // (step * p) + 1
        upto = np.cumsum(count)
        p, count = (x[: max(1, np.searchsorted(upto, SLICE, side="right"))] for x in (p, count))
        total = int(count.sum())
        for lo in range(0, total, SLICE):
            slot = np.arange(lo, min(total, lo + SLICE))
            which = np.searchsorted(upto[: len(p)], slot, side="right")
            period = p[which]
            yield step * period * (slot - (upto[which] - count[which])), period
        first = int(p[-1]) + 1


def runs(words: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of at least ``least`` words and ``exponent`` (2 or more) periods, by start, then period."""
    n = len(words)
    none = np.empty((0, 3), np.int64)
    if n < least or n < exponent:
        return none
    ahead, back = Extensions(words), Extensions(words[::-1])
    found = []
    for i, p in _grid(n, n // exponent, exponent - 1):
        equal = np.flatnonzero(words[i] == words[i + p])
        i, p = i[equal], p[equal]
        if not len(i):
            continue
        f = ahead.between(i, i + p)
        b = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        b[inner] = back.between(n - i[inner] - p[inner], n - i[inner])
        long = f + b >= np.maximum(least - p, (exponent - 1) * p)
        if long.any():
            rows = np.column_stack([i - b, f + b + p, p])[long]
            found.append(_smallest(rows))
    return _smallest(np.concatenate(found)) if found else none


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows with equal start and length the one of the smallest period, by start, then period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(found):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def find(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of every text, and its words without the repeats, joined by spaces."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, rows, texts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = text.split()
                of = runs(numbered(words), least, exponent) if len(words) >= least else np.empty((0, 3), np.int64)
                sizes.append(len(words))
                rows.append(of)
                ends.append(ends[-1] + len(of))
                texts.append(b" ".join(collapsed(words, of)))
            flat = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(shape.value_type))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts, type=shape)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    rows = bounded_batches(docs).select("doc_id", text_of().cast("binary").alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def strongest(found: str = "runs"):
    """The run of the largest exact length by period; of equal ones the first by start, then period."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    empty = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(F.col(found), empty, lambda a, b: F.when(better(a, b), b).otherwise(a))
