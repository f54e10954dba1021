"""Exact quantiles of many columns by radix selection, without holding a column in one task.

A double's bits, turned so that larger numbers have larger bits, are read from the top, ``BITS`` at a time. A scan counts, on
the map side, how many values fall into each cell of the bits read next, for all columns and wanted ranks at once; the cell
that holds a rank is where the next scan goes on. A cell of at most ``few`` values is read to its last bit. So at most four
scans give every order statistic, usually two or three, by the same path at every size; what a scan returns is bounded by
the number of cells, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.columns import as_double

BITS = 16
FEW = 1 << BITS
SIGN = np.uint64(1 << 63)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], few: int = FEW) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}`` with linear interpolation; ``None`` for a column without values."""
    if not cols:
        return {}
    rows = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    whole = [(i, 0, 0, BITS) for i in range(len(cols))]
    first = _histograms(rows, whole)
    n = [int(counts.sum()) for _, counts in first]
    found = _select(rows, first, n, {i: sorted({r for p in probs for r in _bounds(p, n[i])}) for i in range(len(cols)) if n[i]}, few)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = [None] * len(probs)
        for k, p in enumerate(probs if n[i] else []):
            lo, hi = _bounds(p, n[i])
            out[c][k] = _between(found[i, lo], found[i, hi], p * (n[i] - 1) - lo)
    return out


def _between(a: float, b: float, t: float) -> float:
    """Linear interpolation from the nearer end."""
    if a == b:
        return a
    return a + (b - a) * t if t < 0.5 else b - (b - a) * (1.0 - t)


def _bounds(p: float, n: int) -> tuple[int, int]:
    pos = p * (n - 1)
    return math.floor(pos), math.ceil(pos)


def _turned(values: np.ndarray) -> np.ndarray:
    """Bits of doubles in the order of the numbers; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def _number(turned: int) -> float:
    bits = np.uint64(turned)
    return float((bits ^ SIGN if bits & SIGN else ~bits).view(np.float64))


def _histograms(rows: DataFrame, slots: list[tuple[int, int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells in use and their counts for each ``(column, bits read, their value, bits to read)``."""
    columns = sorted({s[0] for s in slots})

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = {k: np.zeros(1 << s[3], np.int64) for k, s in enumerate(slots) if s[3] <= BITS}
        sparse: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            for at, i in enumerate(columns):
                turned = _turned(batch.column(at).drop_null().to_numpy(zero_copy_only=False))
                for k, (c, depth, prefix, width) in enumerate(slots):
                    if c == i:
                        inside = turned[(turned >> np.uint64(64 - depth)) == np.uint64(prefix)] if depth else turned
                        cells = (inside << np.uint64(depth)) >> np.uint64(64 - width)
                        if k in dense:
                            dense[k] += np.bincount(cells.astype(np.int64), minlength=1 << width)
                        else:
                            sparse.append((k, cells.astype(np.int64)))
        for k, counts in dense.items():
            held = np.flatnonzero(counts)
            yield _counted(k, held, counts[held])
        for k in {k for k, _ in sparse}:
            yield _counted(k, *np.unique(np.concatenate([cells for j, cells in sparse if j == k]), return_counts=True))

    def _counted(k: int, cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k, np.int32)), pa.array(cells), pa.array(counts)], ["slot", "cell", "n"])

    found = rows.select(*[f"c{i}" for i in columns]).mapInArrow(work, "slot int, cell long, n long").groupBy("slot", "cell").agg(F.sum("n").alias("n"))
    got = found.toPandas().sort_values(["slot", "cell"])  # at most 2 ** BITS or ``few`` rows a slot
    cuts = np.searchsorted(got["slot"], np.arange(len(slots) + 1))
    cells, counts = got["cell"].to_numpy(), got["n"].to_numpy()
    return [(cells[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:])]


def _select(rows: DataFrame, first: list, n: list[int], ranks: dict[int, list[int]], few: int) -> dict[tuple[int, int], float]:
    """Order statistics ``{(column, zero-based rank): value}``."""
    state = {(i, r): (0, 0, 0, BITS) for i in ranks for r in ranks[i]}  # bits read, their value, values below, bits to read
    found: dict[tuple[int, int], float] = {}
    held = {(i, 0, 0, BITS): h for i, h in enumerate(first)}
    while state:
        for (i, r), (depth, prefix, below, width) in list(state.items()):
            cells, counts = held[i, depth, prefix, width]
            upto = below + np.cumsum(counts)
            at = int(np.searchsorted(upto, r, side="right"))
            depth, prefix, below = depth + width, (prefix << width) | int(cells[at]), int(upto[at] - counts[at])
            if depth == 64:
                found[i, r] = _number(prefix)
                del state[i, r]
            else:
                state[i, r] = depth, prefix, below, 64 - depth if counts[at] <= few else min(BITS, 64 - depth)
        slots = sorted({(i, depth, prefix, width) for (i, _), (depth, prefix, _, width) in state.items()})
        held = dict(zip(slots, _histograms(rows, slots))) if slots else {}
    return found


def iqr_fences(df: DataFrame, cols: list[str], k: float = 1.5) -> dict[str, tuple[float, float] | None]:
    """Inclusive inlier range ``(q1 - k*iqr, q3 + k*iqr)`` per column."""
    out: dict[str, tuple[float, float] | None] = {}
    for c, (q1, q3) in exact_quantiles(df, cols, [0.25, 0.75]).items():
        out[c] = None if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out
