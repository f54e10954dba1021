"""Words, folds and hash samples shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SAMPLE_RANGE = 1 << 31


BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """Let Python read texts in batches of ``BATCH_ROWS`` rows, since texts may be long; a size the user has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def text_of(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def fold(key: Column) -> Column:
    """Fold 0 to 4 of a row; fold 0 is held out of all learning. A null key counts as the empty text (fold 0)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def hash_sample_by(df: DataFrame, group: str, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of ``key`` within each value of ``group``: all rows of a small group, a common quota of the others."""
    counts = cut_lineage(df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")))
    sizes = sorted((r["__n"], r["k"]) for r in counts.groupBy("__n").agg(F.count(F.lit(1)).alias("k")).collect())
    left, groups, quota = rows, sum(k for _, k in sizes), None
    for n, k in sizes:
        if n * groups > left:
            quota = left / groups
            break
        left, groups = left - n * k, groups - k
    if quota is None:
        return df
    over = counts.filter(F.col("__n") > quota).select(F.col(group).alias("__group"), (F.lit(SAMPLE_RANGE * quota) / F.col("__n")).alias("__cut"))
    over = F.broadcast(over) if quota >= 1 else over  # no more than ``rows`` groups are over a quota of one row
    hashed = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(SAMPLE_RANGE))
    rated = df.join(over, F.col(group).eqNullSafe(F.col("__group")), "left")
    return rated.filter(F.col("__cut").isNull() | (hashed < F.col("__cut"))).select(*df.columns)


class Remembered(dict):
    """Values of a function by argument; forgets all when it has grown to ``most``."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def byte_slices(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` bytes together, or one longer text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, with underscores before those that ``taken`` holds in any case."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out
