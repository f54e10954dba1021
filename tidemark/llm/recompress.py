"""Removal of word passages that stand more than once in a corpus, by recompression.

A text is a sequence of symbols, at first its words. A step of recompression names every run of equal symbols, and every
pair of neighbours of which the first falls on the left side of that step's partition of all symbols and the second on the
right. Sides and names are hashes, so they are the same all over the corpus, and where a symbol ends is decided by its two
neighbours alone: after some steps a symbol is a function of its ``context``, the words from which it and its neighbours
were made. Equal passages hold equal symbols wherever a context lies inside the passage.

1. Round of names. Tasks recompress whole texts a few steps, up to symbols whose contexts take half a window; Spark counts
   each name over the corpus. A window around the context of a symbol that stands once stands once itself.
2. Round of high symbols. Texts with other windows are recompressed on, up to symbols longer than a window. A high symbol
   counted twice reveals a long repeat and verifies all windows inside it; one occurrence speaks for them below.
3. Round of windows. What is still open, at the ends of repeats, is settled by counts of the windows' 96-bit hashes.

A round returns what stands once, which is one row a name, so no group of occurrences is ever gathered: counts are added on
the map side, and what is not returned to a text is repeated. Equal texts (96-bit key) take part once, as two copies.

Memory of a task: a slice of a megabyte of text or one text, and some hundred bytes a word of it.

Defined results: a null or empty text has no words and keeps none; a text shorter than a window keeps all; rows that repeat
a ``doc_id`` are documents of their own, so two equal long rows remove each other; a null ``doc_id`` keeps its row; an empty
table gives an empty result; ``mark`` ignores other columns, ``cut`` returns them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Remembered, bounded_batches, byte_slices, text_of
from tidemark.operators.skew import salted_join
from tidemark.session import cut_lineage

WINDOW = 35
KEY = ["k1", "k2"]
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SPANS = "array<struct<start:long,end:long>>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * A
    x ^= x >> np.uint64(29)
    x *= B
    return x ^ (x >> np.uint64(32))


def low_steps(window: int) -> int:
    """Steps after which a context takes about half a window: a step makes symbols longer by a third on random text."""
    steps = 1
    while 7 * (4 / 3) ** (steps + 1) - 6 <= window / 2:
        steps += 1
    return steps


def high_steps(window: int) -> int:
    """Steps after which most symbols are longer than a window."""
    return math.ceil(math.log(1.6 * window) / math.log(4 / 3))


class Symbols:
    """Symbols of the texts of one slice: name, text, words covered, context (outside the text where it is not known)."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.name = words
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.start = np.arange(len(words))
        self.end = self.start + 1
        self.first, self.last = self.start, self.end
        self.step = 0

    def recompress(self) -> None:
        """One step: runs and pairs become symbols."""
        self.step += 1
        text, name = self.text, self.name
        n = len(name)
        if not n:
            return
        near = text[1:] == text[:-1]
        same = near & (name[1:] == name[:-1])
        head = np.flatnonzero(np.append(True, ~same))
        count = np.diff(np.append(head, n))
        base = name[head]
        run = np.where(count > 1, _mix(base ^ _mix(count.astype(np.uint64) + A)), base)
        right = (_mix(base + np.uint64(self.step * int(B) % (1 << 64))) >> np.uint64(40)) & np.uint64(1) == 1
        pair = (text[head[1:]] == text[head[:-1]]) & ~right[:-1] & right[1:]
        lead = np.flatnonzero(np.append(True, ~pair))
        two = np.append(lead[1:], len(head)) - lead == 2
        out = run[lead]
        out[two] = _mix(out[two] * A + run[lead[two] + 1])
        low = head[lead]
        high = np.append(low[1:], n) - 1
        before, after = np.maximum(low - 1, 0), np.minimum(high + 1, n - 1)
        knows = lambda at, of: (at != of) & (text[at] == text[of])
        self.first = np.where(knows(before, low), self.first[before], -n)
        self.last = np.where(knows(after, high), self.last[after], 1 << 62)
        self.start, self.end, self.text, self.name = self.start[low], self.end[high], text[low], out

    def until(self, steps: int) -> Symbols:
        while self.step < steps:
            self.recompress()
        return self


class Slice:
    """Word hashes of some texts, with what is asked of them."""

    def __init__(self, texts: list[bytes], hashes: dict):
        split = [t.split() for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.words = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split)), np.uint64, int(self.sizes.sum()))
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, name and windows (first times the window's size, plus their number less one) of the low symbols with a context in a window."""
        steps = low_steps(window)
        s = Symbols(self.words, self.sizes).until(steps)
        held = np.flatnonzero((s.end - s.start >= steps) & (s.last - s.first <= window) & (s.first >= 0))
        text = s.text[held]
        low = np.maximum(s.last[held] - window - self.offsets[text], 0)
        high = np.minimum(s.first[held] - self.offsets[text], self.sizes[text] - window)
        fits = low <= high
        return text[fits], s.name[held][fits], (low * window + high - low)[fits]

    def high(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word, end and two names of the symbols longer than a window."""
        if not len(self.words):
            return (np.empty(0, np.int64),) * 5
        s = Symbols(self.words, self.sizes).until(high_steps(window))
        inner = (np.arange(len(self.words)) - np.repeat(s.start, s.end - s.start)).astype(np.uint64)
        check = np.add.reduceat(_mix(self.words ^ _mix(inner + B)), s.start)
        held = np.flatnonzero(s.end - s.start >= window)
        text = s.text[held]
        return text, s.start[held] - self.offsets[text], s.end[held] - self.offsets[text], s.name[held].view(np.int64), check[held].view(np.int64)

    def windows(self, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows that start at the given words of the slice."""
        one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        other = _mix(self.words + B)
        for i in range(window):
            one = one * A + self.words[at + i]
            two = two * B + other[at + i]
        return _mix(one).view(np.int64), (_mix(two) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _hashes() -> Remembered:
    return Remembered(xxhash.xxh3_64_intdigest)


def _ranges(flags: np.ndarray) -> np.ndarray:
    """Starts and ends of the stretches of true flags, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))


def _flags(ranges: np.ndarray, size: int) -> np.ndarray:
    """Flags of ``size`` places inside starts and ends."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, ranges[0::2], 1)
    np.add.at(edge, ranges[1::2], -1)
    return np.cumsum(edge[:-1]) > 0


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = text_of()
    return docs.select(*more, F.xxhash64(F.lit("text"), text).alias("k1"), F.hash(text).alias("k2"), text.cast("binary").alias("text"))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.asarray(x if x is not None else [], np.int64) for x in _column(batch, name).to_pylist()]


def _once(rows: DataFrame, names: list[str], of: list[str], n: Column) -> DataFrame:
    """By text, the list of ``at`` of the rows whose names stand once."""
    once = rows.groupBy(*names).agg(n.alias("n"), *[F.min(c).alias(c) for c in (*of, "at")]).filter("n = 1")
    return once.groupBy(*of).agg(F.collect_list("at").alias("once"))


def _low_names(docs: DataFrame, window: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for batch in batches:
            texts = _column(batch, "text").to_pylist()
            for i, j in byte_slices(texts):
                text, name, at = Slice(texts[i:j], hashes).anchors(window)
                of = pa.array(text + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), _column(batch, "k1").take(of), _column(batch, "k2").take(of), pa.array(at)], ["name", *KEY, "at"]
                )

    return _keyed(docs).mapInArrow(work, "name long, k1 long, k2 int, at long")


def _open_windows(n: int, sure: np.ndarray, window: int) -> np.ndarray:
    """Starts and ends of the stretches of windows around no symbol that stands once."""
    edge = np.zeros(max(0, n - window + 1) + 1, np.int64)
    np.add.at(edge, sure // window, 1)
    np.add.at(edge, sure // window + sure % window + 1, -1)
    return _ranges(np.cumsum(edge[:-1]) == 0)


def _open_high(texts: list[bytes], opens: list[np.ndarray], hashes: dict, window: int) -> Iterator[list[dict]]:
    """For each text, its high symbols all of whose windows are open."""
    text, start, end, name, check = Slice(texts, hashes).high(window)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    for k, open_ in enumerate(opens):
        of = slice(cuts[k], cuts[k + 1])
        at = np.searchsorted(open_[0::2], start[of], side="right") - 1
        keep = (at >= 0) & (end[of] - window + 1 <= open_[1::2][np.maximum(at, 0)])
        rows = zip(*(x[of][keep].tolist() for x in (name, check, start, end)))
        yield [{"name": n, "check": c, "at": a, "to": b} for n, c, a, b in rows]


def _screened(docs: DataFrame, once: DataFrame, window: int) -> DataFrame:
    """Every text once, with a number, its words and copies; where windows are ``open``, the text and its high symbols, else its digest."""
    high_kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("name", "check", "at", "to")]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for batch in batches:
            texts, once_ = _column(batch, "text").to_pylist(), _lists(batch, "once")
            n = len(texts)
            sizes, opens, digests, high = [], [None] * n, [None] * n, [None] * n
            for k, text in enumerate(texts):
                words = text.split()
                sizes.append(len(words))
                open_ = _open_windows(len(words), once_[k], window)
                if len(open_):
                    opens[k] = open_
                else:
                    digests[k] = hashlib.sha256(b" ".join(words)).hexdigest()
            left = [k for k in range(n) if opens[k] is not None]
            for i, j in byte_slices([texts[k] for k in left]):
                own = left[i:j]
                for k, rows in zip(own, _open_high([texts[k] for k in own], [opens[k] for k in own], hashes, window)):
                    high[k] = rows
            yield pa.RecordBatch.from_arrays(
                [
                    *(_column(batch, c) for c in (*KEY, "copies")), pa.array(sizes, pa.int64()), pa.array(opens, pa.list_(pa.int64())),
                    pa.array([t if o is not None else None for t, o in zip(texts, opens)], pa.binary()), pa.array(high, high_kind), pa.array(digests, pa.string()),
                ],
                [*KEY, "copies", "n_words", "open", "text", "high", "kept_sha256"],
            )

    texts = _keyed(docs).groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    shape = "k1 long, k2 int, copies long, n_words long, open array<long>, text binary, high array<struct<name:long,check:long,at:long,to:long>>, kept_sha256 string"
    return cut_lineage(texts.join(once, KEY, "left").mapInArrow(work, shape).withColumn("number", F.monotonically_increasing_id()))


def _revealed(texts: DataFrame) -> DataFrame:
    """By text, flat lists of start, end and 1 where it speaks for the windows of a repeated high symbol, 0 where another does."""
    rows = texts.select("number", "copies", F.explode("high").alias("h")).select("number", "copies", "h.*")
    named = rows.groupBy("name", "check").agg(F.sum("copies").alias("n"), F.min(F.struct("number", "at")).alias("first"))
    listed = named.select("first.*", "n")
    speaks = rows.join(listed, ["number", "at"], "left")  # what is not listed is repeated, and another occurrence speaks for it
    held = speaks.filter("n IS NULL OR n > 1").select("number", F.array("at", "to", F.col("n").isNotNull().cast("long")).alias("r"))
    return held.groupBy("number").agg(F.flatten(F.collect_list("r")).alias("sure"))


def _window_names(texts: DataFrame, window: int) -> DataFrame:
    """Open windows, but for those that another occurrence of a high symbol speaks for; ``weight`` 2 where known to be repeated."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for batch in batches:
            whole, opens, sures = _column(batch, "text").to_pylist(), _lists(batch, "open"), _lists(batch, "sure")
            copies = _column(batch, "copies").to_pylist()
            for i, j in byte_slices(whole):
                held = Slice(whole[i:j], hashes)
                text, at, weight = [], [], []
                for k in range(i, j):
                    n = int(held.sizes[k - i]) - window + 1
                    open_ = _flags(opens[k], n)
                    rows = sures[k].reshape(-1, 3)
                    inner = [_flags(np.column_stack([r[:, 0], r[:, 1] - window + 1]).ravel(), n) for r in (rows[rows[:, 2] == 0], rows[rows[:, 2] == 1])]
                    out = np.flatnonzero(open_ & (inner[1] | ~inner[0]))
                    text.append(np.full(len(out), k))
                    at.append(out)
                    weight.append(np.where(inner[1][out] | (copies[k] > 1), 2, 1))
                text, at, weight = (np.concatenate(x) for x in (text, at, weight))
                one, two = held.windows(window, at + held.offsets[text - i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), _column(batch, "number").take(pa.array(text)), pa.array(at), pa.array(weight, pa.int32())],
                    ["h1", "h2", "number", "at", "weight"],
                )

    return texts.mapInArrow(work, "h1 long, h2 int, number long, at long, weight int")


def _settled(texts: DataFrame, window: int) -> DataFrame:
    """``spans``, ``n_removed`` and digest of the texts with open windows, from those that stand once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, removed, digests = [], [], []
            for text, open_, once in zip(_column(batch, "text").to_pylist(), _lists(batch, "open"), _lists(batch, "once")):
                words = text.split()
                repeated = _flags(open_, len(words) - window + 1)
                repeated[once] = False
                found = _ranges(repeated)
                found[1::2] += window - 1
                covered = _flags(found, len(words))
                spans.append([{"start": a, "end": b} for a, b in _ranges(covered).reshape(-1, 2).tolist()])
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~covered)])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(_column(batch, c) for c in (*KEY, "n_words")), pa.array(removed, pa.int64()), pa.array(spans, shape), pa.array(digests, pa.string())],
                [*KEY, "n_words", "n_removed", "spans", "kept_sha256"],
            )

    return texts.mapInArrow(work, f"k1 long, k2 int, n_words long, n_removed long, spans {SPANS}, kept_sha256 string")


def _known(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts with open windows, dealt by number (one exchange, which the plan uses twice), and these with what is revealed."""
    open_ = texts.filter("open IS NOT NULL").select("number", *KEY, "copies", "n_words", "open", "text").repartition("number")
    return open_, open_.join(_revealed(texts), "number", "left")


def _found(docs: DataFrame, window: int) -> DataFrame:
    """One row a distinct text."""
    docs = bounded_batches(docs)
    texts = _screened(docs, _once(_low_names(docs, window), ["name"], KEY, F.count(F.lit(1))), window)
    open_, known = _known(texts)
    once = _once(_window_names(known, window), ["h1", "h2"], ["number"], F.sum("weight"))
    settled = _settled(open_.join(once, "number", "left"), window)
    none = F.array().cast(SPANS)
    rest = texts.filter("open IS NULL").select(*KEY, "n_words", F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), "kept_sha256")
    return cut_lineage(settled.unionByName(rest))


def mark(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` (word numbers, end exclusive) of every row: what repeated windows cover."""
    out = salted_join(_keyed(docs, "doc_id").drop("text"), _found(docs, window), KEY, "doc_id")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the kept words, joined by one space, as ``text``; texts without a repeat stay as they are."""
    columns = docs.columns
    names = {c.lower() for c in columns}
    free = lambda name: next(x for x in (f"{name}{i or ''}" for i in range(len(names) + 1)) if x not in names)
    whole, keys, spans = free("whole"), [free("k1"), free("k2")], free("spans")
    found = _found(docs, window).filter("n_removed > 0").select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), F.col("spans").alias(spans))
    text = text_of()
    rows = docs.withColumns({keys[0]: F.xxhash64(F.lit("text"), text), keys[1]: F.hash(text)}).join(found, keys, "left")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(_column(batch, whole).to_pylist(), _column(batch, spans).to_pylist()):
                if cuts:
                    words, kept, upto = text.split(), [], 0
                    for s in cuts:
                        kept += words[upto : s["start"]]
                        upto = s["end"]
                    text = b" ".join(kept + words[upto:])
                out.append(text)
            arrays = {c: _column(batch, c) for c in columns} | {"text": pa.array(out, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_pydict(arrays)

    rows = bounded_batches(rows).withColumn(whole, F.col("text").cast("string").cast("binary"))
    shape = docs.withColumn("text", F.col("text").cast("string")).schema
    return rows.mapInArrow(work, shape)
