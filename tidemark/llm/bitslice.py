"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to whole numbers, ``floor(64 x)``. A block of rows keeps, per attribute, its values less the block's
smallest as bit slices: one bitmap over the rows per binary digit. A query adds the slices of all attributes, each shifted and taken once
per set digit of the query's weight (negative weights take inverted slices), with carry-save bitmap arithmetic;
the sum slices then hold every row's score less a constant. The best rows are selected from the most significant slice
downward by AND, NOT and popcount; rows tied at the boundary are resolved exactly by id, and scores are read back
from the slices. Many queries are worked at once.

Index rows stay where they were read (a block never leaves its partition before it is written). Blocks are numbered and dealt
to parts in turn, up to ``HELD`` to a part, or fewer while that keeps all cores busy. Every part sees all query blocks: they
stream past the blocks it holds, and each block answers ``k`` rows per query, reduced again before the shuffle of the final ranking.

Defined results: vectors that are null, hold null or non-finite components, or have no id take no part; a query
only meets vectors of its own length; all rows with the query's id are its own; repeated candidates are rows of
their own; scores are sums of 64-bit products and must fit 64 bits; fewer candidates than ``k`` give fewer rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SCALE = 64
BLOCK_ROWS = 8192
QUERY_ROWS = 64
HELD = 16
WORDS_AT_ONCE = 4096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
INDEX = "source int, turn int, dim int, n int, ids binary, low binary, digits binary, slices binary"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, dim, q`` of the vectors that take part."""
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))  # NaN is larger than all
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.filter(F.forall("v", finite))
    return rows.select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(scale * x)).alias("q"))


def _batches(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dim, ids, matrix)`` of up to ``rows`` rows of one length each, sorted by id."""
    held: dict[int, list] = defaultdict(list)

    def close(dim):
        part = sorted(held.pop(dim), key=lambda x: x[0])
        return dim, np.array([p[0] for p in part], np.int64), np.array([p[1] for p in part], np.int64).reshape(len(part), dim)

    for pdf in frames:
        for i, dim, q in zip(pdf["vec_id"].tolist(), pdf["dim"].tolist(), pdf["q"]):
            held[dim].append((i, q))
            if len(held[dim]) == rows:
                yield close(dim)
    for dim in list(held):
        yield close(dim)


def slice_block(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest value and number of digits of each attribute, and all slices as ``(slice, word)``."""
    n, dim = q.shape
    low = q.min(axis=0) if n else np.zeros(dim, np.int64)
    up = (q - low).astype(np.uint64)
    digits = np.array([int(m).bit_length() for m in up.max(axis=0)] if n else [0] * dim, np.uint8)
    words = -(-n // 64)
    out = np.zeros((int(digits.sum()), words * 64), np.uint8)
    s = 0
    for d in range(dim):
        for c in range(digits[d]):
            out[s, :n] = (up[:, d] >> np.uint64(c)) & np.uint64(1)
            s += 1
    return low, digits, np.packbits(out, axis=1, bitorder="little").view(np.uint64).reshape(len(out), words)


def build_index(rows: DataFrame) -> DataFrame:
    """One row per block: ids, smallest values, digits and slices."""

    def work(frames):
        source = TaskContext.get().partitionId()
        for turn, (dim, ids, q) in enumerate(_batches(frames, BLOCK_ROWS)):
            low, digits, slices = slice_block(q)
            yield pd.DataFrame({
                "source": [source], "turn": [turn], "dim": [dim], "n": [len(ids)], "ids": [ids.tobytes()], "low": [low.astype(np.int64).tobytes()],
                "digits": [digits.tobytes()], "slices": [slices.tobytes()],
            })

    return rows.mapInPandas(work, INDEX)


class Block:
    """One block of the index, ready to be searched."""

    def __init__(self, dim: int, n: int, ids: bytes, low: bytes, digits: bytes, slices: bytes):
        self.n, self.ids, self.words = n, np.frombuffer(ids, np.int64), -(-n // 64)
        self.low, self.digits = np.frombuffer(low, np.int64), np.frombuffer(digits, np.uint8)
        self.slices = np.frombuffer(slices, np.uint64).reshape(-1, self.words)
        rows = np.zeros(self.words * 64, np.uint8)
        rows[:n] = 1
        self.rows = np.packbits(rows, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """Slices of every row's score, for each query less a constant, and the constants."""
        pending: dict[int, list[np.ndarray]] = defaultdict(list)

        def push(place: int, x: np.ndarray) -> None:
            stack = pending[place]
            stack.append(x)
            if len(stack) == 3:
                a, b, c = stack
                half = a ^ b
                pending[place] = [half ^ c]
                push(place + 1, (a & b) | (half & c))

        at = 0
        for d, digits in enumerate(self.digits.tolist()):
            w = q[:, d]
            size = np.abs(w).astype(np.uint64)
            flip = np.where(w < 0, FULL, np.uint64(0))[:, None]
            masks = [np.where((size >> np.uint64(b)) & np.uint64(1), FULL, np.uint64(0))[:, None] for b in range(int(size.max()).bit_length())]
            for c in range(digits):
                s = self.slices[at + c][None, :] ^ flip
                for b, mask in enumerate(masks):
                    push(b + c, s & mask)
            at += digits
        out, carry, place = [], None, 0
        while carry is not None or any(k >= place for k, v in pending.items() if v):
            parts = pending.get(place, []) + ([carry] if carry is not None else [])
            carry = None
            if len(parts) == 3:
                a, b, c = parts
                out.append(a ^ b ^ c)
                carry = (a & b) | ((a ^ b) & c)
            elif len(parts) == 2:
                out.append(parts[0] ^ parts[1])
                carry = parts[0] & parts[1]
            else:
                out.append(parts[0] if parts else np.zeros((len(q), self.words), np.uint64))
            place += 1
        full = [(1 << int(x)) - 1 for x in self.digits]
        consts = [sum(int(w) * int(lo) + (int(w) * m if w < 0 else 0) for w, lo, m in zip(row, self.low, full)) for row in q]
        return out, consts

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """``(position of the query, candidate ids, scores)``: its ``k`` best rows of this block."""
        sums, consts = self.sums(q)
        even = np.repeat(self.rows[None, :], len(q), axis=0)
        for i, own in enumerate(query_ids):
            lo, hi = np.searchsorted(self.ids, [own, own + 1])
            for r in range(lo, hi):
                even[i, r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        sure = np.zeros_like(even)
        count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        for s in reversed(sums):
            high = even & s
            n = (count(sure) + count(high))[:, None]
            sure = np.where(n <= k, sure | high, sure)
            even = np.where(n > k, high, np.where(n < k, even & ~s, np.uint64(0)))
        for i in range(len(q)):
            bits = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
            first = bits(sure[i])
            at = np.concatenate([first, bits(even[i])[: k - len(first)]])
            if len(at):
                shift = (at & 63).astype(np.uint64)
                scores = [consts[i]] * len(at)
                for place, s in enumerate(sums):
                    digit = (s[i, at >> 6] >> shift) & np.uint64(1)
                    scores = [v + (int(x) << place) for v, x in zip(scores, digit)]
                yield i, self.ids[at], scores


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of each ``(vec_id, dim, q)`` query."""
    size = index.agg(F.count(F.lit(1)).alias("blocks"), F.max("source").alias("last")).first()
    busy = 2 * index.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(size["blocks"], busy), -(-size["blocks"] // HELD))
    number = F.col("turn").cast("bigint") * ((size["last"] or 0) + 1) + F.col("source")

    def pack(frames):
        for dim, ids, q in _batches(frames, QUERY_ROWS):
            yield pd.DataFrame({"dim": [dim], "n": [len(ids)], "ids": [ids.tobytes()], "slices": [q.tobytes()]})

    asked = queries.dropDuplicates(["vec_id", "q"]).mapInPandas(pack, "dim int, n int, ids binary, slices binary")
    asked = asked.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "query": F.lit(1)})
    held = index.withColumns({"part": F.pmod(number, F.lit(parts)).cast("int"), "query": F.lit(0)}).drop("source", "turn")
    rows = held.unionByName(asked, allowMissingColumns=True).repartitionById(parts, F.col("part"))
    rows = rows.sortWithinPartitions("part", "dim", "query")

    def work(frames):
        place, blocks = None, []
        for pdf in frames:
            for part, query, dim, n, ids, low, digits, slices in zip(*(pdf[c].tolist() for c in ("part", "query", "dim", "n", "ids", "low", "digits", "slices"))):
                if (part, dim) != place:
                    place, blocks = (part, dim), []
                if not query:
                    blocks.append(Block(dim, n, ids, low, digits, slices))
                    continue
                asked_ids, q = np.frombuffer(ids, np.int64), np.frombuffer(slices, np.int64).reshape(n, dim)
                for block in blocks:
                    step = max(1, WORDS_AT_ONCE // block.words)
                    for lo in range(0, n, step):
                        out = [(int(asked_ids[lo + i]), c, s, zlib.crc32(q[lo + i].tobytes())) for i, found, scores in block.search(asked_ids[lo : lo + step], q[lo : lo + step], k) for c, s in zip(found.tolist(), scores)]
                        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score", "__key"])

    found = rows.mapInPandas(work, "query_id long, vec_id long, score long, __key long")
    w = Window.partitionBy("query_id", "__key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` best for each row whose id is divisible by ``every``, against all rows."""
    rows = quantised(vectors)
    index = cut_lineage(build_index(rows))
    return search(index, rows.filter(F.col("vec_id") % every == 0), k)
