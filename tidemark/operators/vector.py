"""Top-k similarity search, a stored coarse index, and nearest-donor imputation.

Nothing that grows passes through the driver: the searched rows are dealt to places of bounded size, queries are shuffled to
the places that can hold an answer, and a task holds one place while its queries stream past. Only each place's ``k`` best rows
of a query go on to the final ranking.

Exact search skips lists by the triangle inequality on the sphere. ``LISTS`` rows of the corpus, chosen by hash, are centres;
every row joins the list of its nearest centre, and a list keeps its widest angle. A query is compared with the centres: the
k-th best of them is a floor of its k-th best similarity, and a list whose angle to the query, less its width, falls below
that floor is skipped. Neighbouring lists share a place up to its size, and a query goes there once however many of them it
needs, so where nothing can be skipped a query travels as often as the corpus has places. A larger list is cut into several.
Places and chunks of queries are of one size, which grows with the tables up to ``BLOCK_VALUES``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.session import cut_lineage, scratch_path

BLOCK_VALUES = 4_000_000  # numbers of one place (32 MB as doubles)
PART_ROWS = 1_000  # rows that are worth a place of their own while cores are idle
SLICE_VALUES = 2_000_000  # scores held at once by a task
LISTS = 1024  # at most; centres are the only vectors that every task sees
SAMPLE_ROWS = 100_000  # rows that the centres of the stored index are learned from
SLACK = 1e-6  # radians, far above the error of an angle
SPACES = 64  # sets of shared columns that donors are laid out for
AXES = 6  # columns of a space in which boxes still tell something
CELLS = 2048  # at most over all spaces; their boxes are what every task sees of the donors
CELL_ROWS = 256
LEAF_ROWS = 128  # donors of a box inside a place
CHUNK_ROWS = 20_000  # rows sent to one place that are worth another copy of it
ROUNDING = 2e-9  # squares are rounded to nine digits


def _top(rows: DataFrame, k: int, score: str, best_first) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(best_first(score), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _units(column) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a column and which rows have one."""
    m = np.array(column.tolist(), dtype=np.float64)
    size = np.linalg.norm(m, axis=1)
    return m / np.where(size > 0, size, 1.0)[:, None], size > 0


def _meet(held: DataFrame, asked: DataFrame, prepare: Callable[[pd.DataFrame], object], search: Callable[[object, pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``search(prepare(held rows), asked rows)`` for every ``place, chunk`` that both have; asked rows come some at a time.

    Both sides have the same columns. One shuffle brings them together; held rows come first and are prepared once.
    """
    both = held.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    rows = both.repartition("place", "chunk").sortWithinPartitions("place", "chunk", "asks")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, kept, ready = None, [], None
        for pdf in batches:
            key = pdf[["place", "chunk", "asks"]].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(pdf)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if tuple(key[lo, :2]) != place:
                    place, kept, ready = tuple(key[lo, :2]), [], None
                if not key[lo, 2]:
                    kept.append(pdf.iloc[lo:hi])
                elif kept or ready is not None:
                    if kept:
                        ready, kept = prepare(pd.concat(kept)), []
                    yield from search(ready, pdf.iloc[lo:hi])

    return rows.mapInPandas(work, schema)


def _side(held: int, asked: int, cores: int, most: int) -> int:
    """Rows of a place and of a chunk of queries: four tasks a core while they are worth it, never more than ``most``."""
    return max(1, min(most, max(PART_ROWS, math.ceil(math.sqrt(held * asked / (4 * cores))))))


def _places(sizes: list[int], per: int, order: list[int] | None = None, kinds: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of places of each list: small neighbours of one kind share a place, large ones are cut."""
    first, number = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    place, filled, kind = 0, 0, None
    for at in order if order is not None else range(len(sizes)):
        if sizes[at]:
            n, mine = math.ceil(sizes[at] / per), kinds[at] if kinds else 0
            if filled and (n > 1 or filled + sizes[at] > per or mine != kind):
                place, filled = place + 1, 0
            first[at], number[at], kind = place, n, mine
            place, filled = (place + n, 0) if n > 1 else (place, filled + sizes[at])
    return first, number


def _chain(centres: np.ndarray) -> list[int]:
    """An order in which each centre is followed by the nearest one that is left."""
    order, left = [0], np.ones(len(centres), bool)
    left[0] = False
    for _ in range(len(centres) - 1):
        order.append(int(np.where(left, centres @ centres[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return order


def _directed(kept: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _units(kept["embedding"])[0], kept["id"].to_numpy()


def _cosine_search(k: int, floor: float, digits: int):
    def search(held: tuple[np.ndarray, np.ndarray], rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        (v, ids), unit = held, 10.0**-digits
        q, asked = _units(rows["embedding"])[0], rows["id"].to_numpy()
        step = max(1, SLICE_VALUES // len(v))
        for at in range(0, len(q), step):
            s = q[at : at + step] @ v.T
            hit = s > floor - unit
            if s.shape[1] > k and np.count_nonzero(hit) > 20 * k * len(s):
                hit &= s >= np.partition(s, -k, axis=1)[:, -k][:, None] - unit
            row, col = np.nonzero(hit)
            score = np.round(s[row, col], digits)
            order = np.lexsort((ids[col], -score, row))
            order = order[score[order] > floor]
            row, col, score = row[order], col[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(s)))[row] < k
            yield pd.DataFrame({"query_id": asked[at + row[keep]], "id": ids[col[keep]], "similarity": score[keep]})

    return search


def _listed(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id, embedding, list`` and the cosine to the list's centre; vectors without a direction fall out."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)
    step = max(1, SLICE_VALUES // len(centres))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), step):
                some = pdf.iloc[at : at + step]
                unit, usable = _units(some["embedding"])
                near = unit @ shared.value.T
                yield some.assign(list=near.argmax(axis=1).astype(np.int32), near=near.max(axis=1))[usable]

    kind = corpus.schema["embedding"].dataType.simpleString()
    return corpus.select(F.col("id").cast("bigint").alias("id"), "embedding").mapInPandas(work, f"id long, embedding {kind}, list int, near double")


def _number(values, at: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), at)


def _asked(queries: DataFrame, centres: np.ndarray, first: np.ndarray, number: np.ndarray, choose: Callable[[np.ndarray], np.ndarray], bare: bool = False) -> DataFrame:
    """A row for every ``place`` that a query is sent to; ``choose(cosines to the centres)`` tells which lists.

    ``bare`` rows are only the numbers of the lists in use, each once a slice.
    """
    total = int((first + number).max(initial=1))
    inside = np.zeros((len(centres), total), np.float32)
    for at, (lo, n) in enumerate(zip(first, number)):
        inside[at, lo : lo + n] = 1
    shared = queries.sparkSession.sparkContext.broadcast((centres, inside))
    step = max(1, SLICE_VALUES // max(len(centres), total * max(1, centres.shape[1])))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, inside = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), step):
                some = pdf.iloc[at : at + step]
                unit, usable = _units(some["embedding"])
                chosen = choose(unit @ centres.T) & usable[:, None]
                if bare:
                    yield pd.DataFrame({"list": np.flatnonzero(chosen.any(axis=0) & (inside.sum(axis=1) > 0)).astype(np.int32)})
                else:
                    row, place = np.nonzero(chosen.astype(np.float32) @ inside)
                    yield some.iloc[row].assign(place=place.astype(np.int64))

    kind = queries.schema["embedding"].dataType.simpleString()
    rows = queries.select(F.col("query_id").cast("bigint").alias("id"), "embedding")
    return rows.mapInPandas(work, "list int" if bare else f"id long, embedding {kind}, place long")


def _in_chunks(held: DataFrame, asked: DataFrame, chunks: int) -> tuple[DataFrame, DataFrame]:
    """Every place with each of the chunks that the queries are dealt to."""
    return (
        held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))),
        asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")),
    )


def _sizes(table: DataFrame, lists: int, width: int = 1, block_values: int = 1) -> tuple[list[int], np.ndarray]:
    """Blocks of each list (its rows, where none are named), and its widest angle to the centre."""
    per = max(1, block_values // max(1, width))
    parts, angle = [0] * lists, np.zeros(lists)
    for r in table.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect():  # one row a list
        parts[r["list"]], angle[r["list"]] = math.ceil(r["n"] / per), math.acos(min(1.0, max(-1.0, r["near"])))
    return parts, angle


def topk_cosine(
    queries: DataFrame, corpus: DataFrame, k: int = 5, min_similarity: float = 0.3, digits: int = 12, block_values: int = BLOCK_VALUES, lists: int = LISTS
) -> DataFrame:
    """``(query_id, id, similarity, rank)`` with similarity above the floor; ties by id.

    ``queries`` has ``query_id, embedding``, ``corpus`` has ``id, embedding``; both ids are integers.
    """
    spark = queries.sparkSession
    queries, corpus = queries.filter("embedding IS NOT NULL"), corpus.filter("embedding IS NOT NULL").select("id", "embedding")
    usable = corpus.filter(vectors.norm(F.col("embedding")) > 0)
    n, asking = corpus.count(), queries.count()
    wanted = min(lists, math.ceil(math.sqrt(n)))
    first = usable.orderBy(F.xxhash64(F.lit("centre"), "id"), "id").limit(wanted).collect()  # at most ``lists`` rows
    if not first:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    centres = _units(pd.Series([r["embedding"] for r in first]))[0]
    table = cut_lineage(_listed(usable, centres))
    sizes, angle = _sizes(table, len(centres))
    side = _side(n, asking, spark.sparkContext.defaultParallelism, block_values // max(1, centres.shape[1]))
    start, number = _places(sizes, side, _chain(centres))

    def choose(near: np.ndarray) -> np.ndarray:
        least = np.full(len(near), min_similarity)
        if near.shape[1] >= k:  # the centres are rows of the corpus
            least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
        apart = np.arccos(np.clip(near, -1, 1)) - angle[None, :]
        return apart <= np.arccos(np.clip(least, -1, 1))[:, None] + SLACK

    place = _number(start, F.col("list")) + F.pmod(F.xxhash64("id"), _number(number, F.col("list")))
    held, asked = _in_chunks(table.select("id", "embedding", place.alias("place")), _asked(queries, centres, start, number, choose), max(1, math.ceil(asking / side)))
    found = _meet(held, asked, _directed, _cosine_search(k, min_similarity, digits), "query_id long, id long, similarity double")
    return _top(found, k, "similarity", F.desc)


class CoarseIndex:
    """Vectors stored by list; a search reads only the lists nearest to its queries (approximate).

    ``build`` learns centres from at most ``SAMPLE_ROWS`` rows, chosen by hash, assigns every row once and writes the lists as
    folders of a table; ``open`` takes such a table up again.
    """

    def __init__(self, corpus: DataFrame, lists: int = 50, seed: int = 42, path: str | None = None):
        spark = corpus.sparkSession
        self.path = path or scratch_path(spark, "index")
        usable = corpus.filter("embedding IS NOT NULL").select("id", "embedding").filter(vectors.norm(F.col("embedding")) > 0)
        n = usable.count()
        share = min(1.0, SAMPLE_ROWS / max(1, n))
        sample = usable.filter(F.pmod(F.xxhash64(F.lit("index"), "id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else usable
        features = sample.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
        if n:
            model = KMeans(k=max(2, min(lists, n)), seed=seed, distanceMeasure="cosine", maxIter=10).fit(features)
            centres = np.array(model.clusterCenters())
            centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)
            rows = cut_lineage(_listed(usable, centres))
            width = centres.shape[1]
            parts, _ = _sizes(rows, len(centres), width, BLOCK_VALUES)
            out = rows.select("id", "embedding", "list", F.pmod(F.xxhash64("id"), _number(parts, F.col("list"))).cast("int").alias("part"))
            out.repartition("list", "part").write.partitionBy("list").parquet(f"{self.path}/rows")
        else:
            centres, parts = np.zeros((0, 0)), []
            usable.withColumns({"part": F.lit(0), "list": F.lit(0)}).write.parquet(f"{self.path}/rows")
        listed = [(i, p, c.tolist()) for i, (p, c) in enumerate(zip(parts, centres))]
        spark.createDataFrame(listed, "list int, parts int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/lists")
        self._read(spark, usable.schema["embedding"].dataType.simpleString())

    @classmethod
    def open(cls, spark: SparkSession, path: str, kind: str = "array<float>") -> CoarseIndex:
        index = cls.__new__(cls)
        index.path = path
        index._read(spark, kind)
        return index

    def _read(self, spark: SparkSession, kind: str) -> None:
        known = spark.read.parquet(f"{self.path}/lists").orderBy("list").collect()  # one row a list
        self.parts = [r["parts"] for r in known]
        self.centres = np.array([r["centre"] for r in known], dtype=np.float64)
        self.table = spark.read.schema(f"id long, embedding {kind}, part int, list int").parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int = 5, probes: int = 5, min_similarity: float = 0.3, digits: int = 12) -> DataFrame:
        """``(query_id, id, similarity, rank)`` from the ``probes`` lists nearest to each query."""
        if not self.parts:
            return queries.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int")

        def choose(near: np.ndarray) -> np.ndarray:
            mask = np.zeros(near.shape, bool)
            np.put_along_axis(mask, np.argsort(-near, axis=1)[:, :probes], True, axis=1)
            return mask

        queries = queries.filter("embedding IS NOT NULL")
        number = np.array(self.parts)
        start = np.cumsum(number) - number
        wanted = [r["list"] for r in _asked(queries, self.centres, start, number, choose, bare=True).distinct().collect()]  # at most one row a list
        asking, width = queries.count(), self.centres.shape[1]
        held = self.table.filter(F.col("list").isin(wanted)).select("id", "embedding", (_number(start, F.col("list")) + F.col("part")).alias("place"))
        side = max(PART_ROWS, BLOCK_VALUES // max(1, width))
        held, asked = _in_chunks(held, _asked(queries, self.centres, start, number, choose), max(1, math.ceil(asking / side)))
        found = _meet(held, asked, _directed, _cosine_search(k, min_similarity, digits), "query_id long, id long, similarity double")
        return _top(found, k, "similarity", F.desc)


def knn_impute(
    rows: DataFrame, key: str, cols: list[str], donors: DataFrame | None = None, k: int = 5, block_values: int = BLOCK_VALUES, cells: int = CELLS
) -> DataFrame:
    """Gaps filled with the mean of the k nearest donors that know the column.

    Distance is Euclidean over the columns both rows know, scaled up for the unknown ones; ties go to the
    smaller key. A column without any usable donor gets the column mean. ``key`` is an integer column that names a row.
    Differences are squared one by one, so close rows far from zero keep their digits.

    Donors that know the same columns are laid out once for each set of columns they share with some incomplete row (a
    space). A space is cut into cells by median splits; a row is sent only to the places whose cells can hold one of its
    ``k`` nearest, judged by the cells' boxes. With more than ``SPACES`` spaces, or spaces of more than ``AXES`` columns, boxes
    tell little, and every incomplete row meets every part of the donors.
    """
    donors = rows if donors is None else donors
    gap = F.lit(False)
    for c in cols:
        gap = gap | F.col(c).isNull()
    names = [f"c{i}" for i in range(len(cols))]
    packed = [F.col(c).cast("double").alias(n) for c, n in zip(cols, names)]
    pool = donors.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("id"), *packed)
    means = [F.avg(n).alias(f"m{i}") for i, n in enumerate(names)]
    endless = F.count_if(F.exists(F.array(*names), lambda x: F.abs(x) == math.inf)).alias("endless")
    known = pool.agg(F.count(F.lit(1)).alias("n"), endless, *means).first()
    needy = rows.filter(gap & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), *packed)
    schema = "query_id long, col int, id long, distance double, value double"
    spaces = _spaces(pool, needy, names) if not known["endless"] and len(cols) < 63 else None
    if spaces is None:
        out = _meet(*_all_parts(pool, needy, known["n"], block_values // max(1, 8 * len(cols))), _numbers(names), _donor_search(names, k), schema)
    elif spaces:
        out = _near_donors(pool, needy, names, spaces, k, block_values, cells, schema)
    else:
        out = rows.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query_id", "col").orderBy("distance", "id")
    near = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    per = near.groupBy("query_id").agg(*[F.avg(F.when(F.col("col") == i, F.col("value"))).alias(f"__f{i}") for i in range(len(cols))])
    joined = rows.join(per.withColumnRenamed("query_id", key), key, "left")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__f{i}"), F.lit(known[f"m{i}"])) for i, c in enumerate(cols)}
    return joined.withColumns(filled).select(*rows.columns)


def _knows(names: list[str]) -> Column:
    """The columns a row knows, as bits."""
    return sum((F.when(F.col(n).isNotNull() & ~F.isnan(n), 1 << i).otherwise(0).cast("bigint") for i, n in enumerate(names)), F.lit(0).cast("bigint"))


def _spaces(pool: DataFrame, needy: DataFrame, names: list[str]) -> list[tuple[int, int]] | None:
    """``(shared columns, columns the donors know)`` of every space in use; none if boxes would tell little."""
    have, ask = ([r["bits"] for r in side.select(_knows(names).alias("bits")).distinct().limit(SPACES + 1).collect()] for side in (pool, needy))
    if max(len(have), len(ask)) > SPACES:
        return None
    spaces = sorted({(q & d, d) for q in ask for d in have if q & d and d & ~q})
    return spaces if len(spaces) <= SPACES and all(s.bit_count() <= AXES for s, _ in spaces) else None


def _all_parts(pool: DataFrame, needy: DataFrame, n: int, per: int) -> tuple[DataFrame, DataFrame]:
    busy = min(pool.sparkSession.sparkContext.defaultParallelism, math.ceil(n / PART_ROWS))
    parts = max(1, busy, math.ceil(n / max(1, per)))
    held = pool.withColumns({"place": F.pmod(F.xxhash64("id"), F.lit(parts)), "chunk": F.lit(0)})
    return held, needy.withColumns({"place": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")), "chunk": F.lit(0)})


def _numbers(names: list[str]):
    return lambda kept: (kept[names].to_numpy(np.float64), kept["id"].to_numpy())


def _donor_search(names: list[str], k: int):
    width = len(names)

    def search(held: tuple[np.ndarray, np.ndarray], rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        v, ids = held
        step = max(1, SLICE_VALUES // (4 * len(v)))
        for at in range(0, len(rows), step):
            q, asked = rows[names].to_numpy(np.float64)[at : at + step], rows["id"].to_numpy()[at : at + step]
            square, both = np.zeros((len(q), len(v))), np.zeros((len(q), len(v)))
            for c in range(width):
                apart = q[:, c][:, None] - v[:, c][None, :]
                shared = ~np.isnan(apart)
                square += np.where(shared, apart, 0.0) ** 2
                both += shared
            usable = (both > 0) & (asked[:, None] != ids[None, :])
            near = -np.sqrt(np.round(square, 9) * width / np.maximum(both, 1))
            for c in range(width):
                needs = np.flatnonzero(np.isnan(q[:, c]))
                row, col = _best(needs, ids, near[needs], usable[needs] & ~np.isnan(v[:, c]), k)
                yield pd.DataFrame({"query_id": asked[needs[row]], "col": np.int32(c), "id": ids[col], "distance": -near[needs[row], col], "value": v[col, c]})

    return search


def _best(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray, hit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` largest scores among the hits, ties by the column's key."""
    if scores.shape[1] > k:
        hit = hit & (scores >= np.partition(np.where(hit, scores, -np.inf), -k, axis=1)[:, -k][:, None])
    row, col = np.nonzero(hit)
    order = np.lexsort((keys[col], -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(ids)))[row] < k
    return row[keep], col[keep]


def _tree(points: np.ndarray, axes: list[int], leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Median splits along the widest of the axes: axis, cut, lower and upper child of each node; a leaf has axis -1 and its number."""
    nodes, found = [], 0

    def grow(points: np.ndarray, leaves: int) -> int:
        nonlocal found
        at = len(nodes)
        nodes.append((-1, 0.0, found, found))
        if leaves > 1 and len(points) > 1:
            axis = max(axes, key=lambda i: np.ptp(points[:, i]))
            x = points[:, axis]
            cut = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
            if cut == x.max() > x.min():
                cut = x[x < cut].max()
            if cut < x.max():
                low = grow(points[x <= cut], leaves // 2)
                nodes[at] = (axis, cut, low, grow(points[x > cut], leaves - leaves // 2))
                return at
        found += 1
        return at

    grow(points, leaves)
    axis, cut, low, high = zip(*nodes)
    return np.array(axis), np.array(cut), np.array(low), np.array(high)


def _leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], points: np.ndarray) -> np.ndarray:
    """Number of the leaf of each point."""
    axis, cut, low, high = tree
    node, every = np.zeros(len(points), np.int64), np.arange(len(points))
    while (inner := axis[node] >= 0).any():
        below = points[every, np.maximum(axis[node], 0)] <= cut[node]
        node = np.where(inner, np.where(below, low[node], high[node]), node)
    return low[node]


def _reach(q: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, axes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which boxes can hold one of the ``k`` nearest of each point, and the square that these stay below."""
    near, far = np.zeros((len(q), len(n))), np.zeros((len(q), len(n)))
    for i in axes:
        x = q[:, i][:, None]
        below, above = low[:, i] - x, x - high[:, i]
        near += np.maximum(np.maximum(below, above), 0.0) ** 2
        far += np.minimum(below, above) ** 2
    bound = far[:, n > k].min(axis=1, initial=np.inf) * (1 + 1e-12) + ROUNDING  # one of them may be the row itself
    return near <= bound[:, None], bound


def _axes(shared: int) -> list[int]:
    return [i for i in range(shared.bit_length()) if shared >> i & 1]


def _near_donors(pool: DataFrame, needy: DataFrame, names: list[str], spaces: list[tuple[int, int]], k: int, block_values: int, cells: int, schema: str) -> DataFrame:
    """The ``k`` nearest donors of every incomplete row in every space that serves it, from the places it is sent to."""
    spark, width = pool.sparkSession, len(names)
    kept = ", ".join(f"{n} double" for n in names)
    known = spark.createDataFrame([(d, i, s) for i, (s, d) in enumerate(spaces)], "bits long, space int, shared long")
    laid = pool.withColumn("bits", _knows(names)).join(F.broadcast(known), "bits")
    # of equal places the k smallest keys win, and one more where the row itself is among them
    spot = [F.when(F.col("shared").bitwiseAND(F.lit(1 << i)) != 0, F.col(n)) for i, n in enumerate(names)]
    rank = F.row_number().over(Window.partitionBy("space", *spot).orderBy("id"))
    points = cut_lineage(laid.withColumn("rank", rank).filter(F.col("rank") <= k + 1).select("space", "id", *names))
    sizes = {r["space"]: r["n"] for r in points.groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a space
    total, asking = sum(sizes.values()), needy.count()
    leaves = {i: max(1, min(cells // len(spaces), math.ceil(n / CELL_ROWS))) for i, n in sizes.items()}
    share = _number([(1 << 30) * min(1.0, 16 * leaves[i] / sizes[i]) if i in sizes else 0 for i in range(len(spaces))], F.col("space"))
    # the splits come from some 16 rows a cell; they decide how rows are dealt, the boxes are those of all rows
    sample = points.filter(F.pmod(F.xxhash64(F.lit("cell"), "id"), F.lit(1 << 30)) < share).toPandas()
    trees, offset, kinds = {}, {}, []
    for i, (shared, _) in enumerate(spaces):
        if i in sizes:
            trees[i] = _tree(sample.loc[sample["space"] == i, names].to_numpy(np.float64), _axes(shared), leaves[i])
            offset[i] = len(kinds)
            kinds += [i] * int(trees[i][2][trees[i][0] < 0].max() + 1)
    grown = spark.sparkContext.broadcast((trees, offset))

    def place_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, offset = grown.value
        for pdf in batches:
            for i, some in pdf.groupby("space"):
                yield some.assign(cell=(_leaf(trees[i], some[names].to_numpy(np.float64)) + offset[i]).astype(np.int32))

    placed = points.mapInPandas(place_cells, f"space int, id long, {kept}, cell int")
    low, high = np.full((len(kinds), width), np.nan), np.full((len(kinds), width), np.nan)
    n = np.zeros(len(kinds), np.int64)
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in names]
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect():  # one row a cell
        n[r["cell"]] = r["n"]
        low[r["cell"]] = [np.nan if r[f"min_{c}"] is None else r[f"min_{c}"] for c in names]
        high[r["cell"]] = [np.nan if r[f"max_{c}"] is None else r[f"max_{c}"] for c in names]
    per = max(1, min(block_values // (8 * width), max(PART_ROWS, math.ceil(total / (4 * spark.sparkContext.defaultParallelism)))))
    first, number = _places(n.tolist(), per, kinds=kinds)
    boxes = spark.sparkContext.broadcast((low, high, n, np.array(kinds), first, number))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, n, kinds, first, number = boxes.value
        total = int((first + number).max())
        for pdf in batches:
            q = pdf[names].to_numpy(np.float64)
            bits = (~np.isnan(q)).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
            for i, (shared, donors) in enumerate(spaces):
                mine = np.flatnonzero((kinds == i) & (n > 0))
                rows = np.flatnonzero(((bits & donors) == shared) & ((donors & ~bits) != 0))
                step = max(1, SLICE_VALUES // (8 * max(1, len(mine))))
                for at in range(0, len(rows) if len(mine) else 0, step):
                    some = rows[at : at + step]
                    row, cell = np.nonzero(_reach(q[some], low[mine], high[mine], n[mine], _axes(shared), k)[0])
                    cell = mine[cell]
                    parts = number[cell]
                    place = np.repeat(first[cell], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    pair = np.unique(np.repeat(row, parts) * total + place)
                    yield pdf.iloc[some[pair // total]].assign(place=pair % total, space=np.int32(i))

    asked = cut_lineage(needy.mapInPandas(send, f"id long, {kept}, place long, space int"))
    chunks = [1] * int((first + number).max(initial=1))
    for r in asked.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a place
        chunks[r["place"]] = math.ceil(r["n"] / max(CHUNK_ROWS, asking // (4 * spark.sparkContext.defaultParallelism)))
    cut = _number(chunks, F.col("place"))
    at = _number(first, F.col("cell")) + F.pmod(F.xxhash64("id"), _number(number, F.col("cell")))
    held = placed.select("id", *names, at.alias("place"), "space").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), cut - 1)))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), cut))

    def prepare(kept: pd.DataFrame):
        axes = _axes(spaces[kept["space"].iloc[0]][0])
        v, ids = kept[names].to_numpy(np.float64), kept["id"].to_numpy()
        leaf = _leaf(_tree(v, axes, math.ceil(len(v) / LEAF_ROWS)), v)
        order = np.argsort(leaf, kind="stable")
        v, ids, leaf = v[order], ids[order], leaf[order]
        starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        return axes, v, ids, starts, np.diff(np.r_[starts, len(v)]), np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)

    def search(ready, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        axes, v, ids, starts, sizes, low, high = ready
        every, asked = rows[names].to_numpy(np.float64), rows["id"].to_numpy()
        step = max(1, SLICE_VALUES // (8 * len(sizes)))
        for at in range(0, len(every), step):
            q = every[at : at + step]
            hit, bound = _reach(q, low, high, sizes, axes, k)
            upto = np.cumsum(hit @ sizes)  # pairs of rows, some at a time
            cuts = [0, *np.searchsorted(upto, np.arange(SLICE_VALUES // 4, upto[-1], SLICE_VALUES // 4), side="right"), len(q)]
            for lo, hi in zip(cuts, cuts[1:]):
                row, leaf = np.nonzero(hit[lo:hi])
                if len(row):
                    row, parts = row + lo, sizes[leaf]
                    point = np.repeat(starts[leaf] - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())
                    row = np.repeat(row, parts)
                    square = np.zeros(len(row))
                    for i in axes:
                        square += (q[row, i] - v[point, i]) ** 2
                    near = np.flatnonzero((square <= bound[row]) & (asked[at + row] != ids[point]))
                    row, point, square = row[near], point[near], square[near]
                    apart = np.sqrt(np.round(square, 9) * width / len(axes))
                    order = np.lexsort((ids[point], apart, row))
                    row, point, apart = row[order], point[order], apart[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, point, apart = row[keep], point[keep], apart[keep]
                    for c in range(width):
                        use = np.flatnonzero(np.isnan(q[row, c]) & ~np.isnan(v[point, c]))
                        yield pd.DataFrame({"query_id": asked[at + row[use]], "col": np.int32(c), "id": ids[point[use]], "distance": apart[use], "value": v[point[use], c]})

    return _meet(held, asked, prepare, search, schema)
