"""Points within a radius of centres, met area by area: what tasks do with arrays of positions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext

from tidemark.functions import geo

GATHER = 16_384  # neighbouring positions that are cut together
BLOCK = 64  # centres of an area that are judged together
NO_ID = np.iinfo(np.int64).max
SIDES = [f"{e}_{v}" for e in ("lo", "hi") for v in "xyz"]
TOTAL, OPEN, FAR = 0, 1, 2
FOUND = "q_lat double, q_lon double, lat double, lon double, n long, first long, kind int"


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)])


def halves(at: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in parts of at most ``size``, by halving the longest side."""
    todo, out = [np.arange(len(at))], []
    while todo:
        i = todo.pop()
        if len(i) <= size:
            out.append(i)
            continue
        i = i[np.argsort(at[i, np.ptp(at[i], axis=0).argmax()], kind="stable")]
        todo += [i[len(i) // 2 :], i[: len(i) // 2]]
    return out


def square(chord: float) -> float:
    """For comparison with squares; nothing is as near as a chord below 0."""
    return chord * chord if chord >= 0 else -1.0


def cells(at: np.ndarray, bits: int, reach: float | None) -> np.ndarray:
    """Packed grid cells that hold one of the positions, or that a ball of radius ``reach`` around one can touch."""
    top, step = (1 << bits) - 1, 2.0 / (1 << bits)
    home = np.clip(np.floor((at + 1) / 2 * (1 << bits)), 0, top).astype(np.int64)
    found = []
    for move in [(0, 0, 0)] if reach is None else itertools.product((-1, 0, 1), repeat=3):
        cell = home + np.array(move)
        keep = ((cell >= 0) & (cell <= top)).all(axis=1)
        if reach is not None:
            low = cell * step - 1
            gap = np.maximum(0, np.maximum(low - at, at - (low + step)))
            keep &= (gap * gap).sum(axis=1) <= square(reach) * (1 + 1e-9)
        cell = cell[keep]
        found.append(np.unique(cell[:, 0] << 2 * geo.CELL_BITS | cell[:, 1] << geo.CELL_BITS | cell[:, 2]))
    return np.unique(np.concatenate(found))


def bags(size: int, bits: int, reach: float | None):
    """Neighbouring positions in bags of at most ``size``: their number, box, cells and columns. For rows in the order of a grid."""

    def cut(rows: pd.DataFrame, names: Iterator[int]) -> pd.DataFrame:
        at = unit(rows["latitude"].to_numpy(), rows["longitude"].to_numpy())
        out = []
        for i in halves(at, size):
            part = rows.iloc[i]
            box = [float(x) for x in (*at[i].min(axis=0), *at[i].max(axis=0))]
            n, first = part["n"].to_numpy(), part["first"].to_numpy()
            out.append((next(names), *box, cells(at[i], bits, reach), int(n.sum()), int(first.min()), part["latitude"].to_numpy(), part["longitude"].to_numpy(), n, first))
        return pd.DataFrame(out, columns=["bag", *SIDES, "cells", "n", "first", "lat", "lon", "ns", "firsts"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = itertools.count(TaskContext.get().partitionId() << 33)
        held, rows = [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= GATHER:
                yield cut(pd.concat(held, ignore_index=True), names)
                held, rows = [], 0
        if rows:
            yield cut(pd.concat(held, ignore_index=True), names)

    return work


class Area:
    """Centres that lie together, with what they have met: how many, the smallest id, the farthest that surely counts."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, n: int, first: int, outer: float, inner: float, margin: float):
        at = unit(lat, lon)
        parts = halves(at, BLOCK)
        order = np.concatenate(parts)
        self.ends = np.cumsum([0, *map(len, parts)])
        self.lat, self.lon, self.at = lat[order], lon[order], at[order]
        self.low, self.high = (np.array([f(at[i], axis=0) for i in parts]) for f in (np.min, np.max))
        self.outer, self.inner, self.margin = square(outer), square(inner), margin
        self.hits, self.first = np.full(len(at), n), np.full(len(at), first)
        self.far, self.far_at = np.full(len(at), -1.0), np.full((len(at), 2), np.nan)

    def _least(self, rows) -> np.ndarray:
        """What a point must be away to be the farthest, by a distance that differs from the sphere's by ``margin`` at most."""
        far = self.far[rows]
        if self.margin == 1.0:
            return far
        back = 2 * np.sin(np.arcsin(np.minimum(1.0, np.sqrt(np.maximum(far, 0)) / 2)) / self.margin**2) * (1 - 1e-9)
        return np.where(far < 0, -1.0, back * back)

    def meet(self, lat: np.ndarray, lon: np.ndarray, ns: np.ndarray, firsts: np.ndarray, counted: bool) -> list[tuple]:
        """Takes in a bag; returns columns of pairs that the exact distance has to decide."""
        p = unit(lat, lon)
        low, high = p.min(axis=0), p.max(axis=0)
        gap = np.maximum(0, np.maximum(low - self.high, self.low - high))
        reach = np.maximum(high - self.low, self.high - low)
        near, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        out = []
        for b in np.flatnonzero((near <= self.outer) | counted):
            rows = np.arange(self.ends[b], self.ends[b + 1])
            whole = counted or most[b] <= self.inner
            if whole:
                if not counted:
                    self.hits[rows] += ns.sum()
                    self.first[rows] = np.minimum(self.first[rows], firsts.min())
                side = np.maximum(high - self.at[rows], self.at[rows] - low)
                rows = rows[(side * side).sum(axis=1) * (1 + 1e-12) > self._least(rows)]
                if not len(rows):
                    continue
            c = self.at[rows]
            d = np.square(c[:, :1] - p[:, 0])
            d += np.square(c[:, 1:2] - p[:, 1])
            d += np.square(c[:, 2:] - p[:, 2])
            if not whole:
                sure = d <= self.inner
                self.hits[rows] += np.where(sure, ns, 0).sum(axis=1)
                self.first[rows] = np.minimum(self.first[rows], np.where(sure, firsts, NO_ID).min(axis=1))
                i, j = np.nonzero((d <= self.outer) & ~sure)
                if len(i):
                    out.append((self.lat[rows[i]], self.lon[rows[i]], lat[j], lon[j], ns[j], firsts[j], np.full(len(i), OPEN)))
                d = np.where(sure, d, -1.0)
            k = d.argmax(axis=1)
            top = d[np.arange(len(rows)), k]
            more = top > self.far[rows]
            self.far[rows[more]] = top[more]
            self.far_at[rows[more]] = np.column_stack([lat[k[more]], lon[k[more]]])
            if self.margin != 1.0:
                i, j = np.nonzero((d >= 0) & (d >= self._least(rows)[:, None]))
                out.append((self.lat[rows[i]], self.lon[rows[i]], lat[j], lon[j], np.zeros(len(i), np.int64), np.full(len(i), NO_ID), np.full(len(i), FAR)))
        return out

    def totals(self) -> tuple:
        return self.lat, self.lon, self.far_at[:, 0], self.far_at[:, 1], self.hits, self.first, np.full(len(self.hits), TOTAL)


def meetings(outer: float, inner: float, margin: float):
    """For rows by ``area, part, side``: an area's centres, then the bags it meets, far ones first."""

    def frame(found: list[tuple]) -> pd.DataFrame:
        columns = [np.concatenate(c) for c in zip(*found)]
        return pd.DataFrame(dict(zip(("q_lat", "q_lon", "lat", "lon", "n", "first", "kind"), columns)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, area = None, None
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                if (r.area, r.part) != place:
                    if area is not None:
                        found.append(area.totals())
                    place, area = (r.area, r.part), Area(r.lat, r.lon, r.n, r.first, outer, inner, margin)
                else:
                    found += area.meet(r.lat, r.lon, r.ns, r.firsts, r.counted)
                if sum(len(f[0]) for f in found) >= GATHER:
                    yield frame(found)
                    found = []
            if found:
                yield frame(found)
        if area is not None:
            yield frame([area.totals()])

    return work
