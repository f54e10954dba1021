"""Ordered operators whose groups may be far larger than one task.

A plain window holds a whole key group in one task. Here the order is first cut into buckets at its
global quantiles, so a bucket holds about ``target_rows`` rows whatever the keys do. Each (key,
bucket) is reduced to one small summary row; the summaries are chained per key; the chained value enters
the bucket as one leading row, and the window then runs per (key, bucket). The rows shuffle once.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

TARGET_ROWS = 2_000_000
MAX_BUCKETS = 2_000
BUCKET = "__bucket"
BODY = "__body"


def order_value(df: DataFrame, name: str) -> Column:
    """The order column as a double usable for bucketing."""
    dt = df.schema[name].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    return F.col(name).cast("double")


def with_order_buckets(df: DataFrame, order: list[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add an order-preserving bucket number of about ``target_rows`` rows.

    One bounded sketch of the first order column gives the borders. A value so frequent that it fills
    several buckets shows up as a repeated border; its rows are split again by the next order column.
    Where a text comes first, or second after such a value, rows are dealt by range of the whole order instead and written,
    since the borders of another evaluation might differ.
    """
    buckets = min(MAX_BUCKETS, math.ceil(df.count() / target_rows))
    if buckets <= 1:
        return df.withColumn(BUCKET, F.lit(0.0))
    text = [isinstance(df.schema[o].dataType, T.StringType) for o in order[:2]]
    if any(text):
        return cut_lineage(df.repartitionByRange(buckets, *order).withColumn(BUCKET, F.spark_partition_id().cast("double")))
    first = order_value(df, order[0])
    borders = df.agg(F.percentile_approx(first, [i / buckets for i in range(1, buckets)], 5 * buckets)).first()[0]
    edges = [-math.inf, *sorted(set(borders)), math.inf]
    cut = Bucketizer(splits=edges, inputCol="__order_value", outputCol=BUCKET, handleInvalid="keep")
    out = cut.transform(df.withColumn("__order_value", first))
    heavy = {v: k for v, k in Counter(borders).items() if k > 1}
    if heavy and len(order) > 1:
        out = _split_heavy(out, order[1], heavy)
    return out.drop("__order_value")


def _split_heavy(df: DataFrame, second: str, heavy: dict[float, int]) -> DataFrame:
    """Rows of a frequent first value take fractions below one half, the rest of their bucket comes after."""
    value = order_value(df, second)
    aggs = [
        F.percentile_approx(F.when(F.col("__order_value") == F.lit(v), value), [i / (k + 1) for i in range(1, k + 1)], 5 * MAX_BUCKETS)
        for v, k in heavy.items()
    ]
    splits = df.agg(*[a.alias(f"s{i}") for i, a in enumerate(aggs)]).first()
    place = F.lit(0.75)
    for i, (v, k) in enumerate(heavy.items()):
        below = F.size(F.filter(F.array(*[F.lit(float(x)) for x in sorted(set(splits[i]))]), lambda s: s < value))
        place = F.when(F.col("__order_value") == F.lit(v), below / F.lit(2.0 * (k + 1))).otherwise(place)
    return df.withColumn(BUCKET, F.col(BUCKET) + place)


def _join_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    return rows.withColumn(BODY, F.lit(1)).unionByName(carry.withColumn(BODY, F.lit(0)), allowMissingColumns=True)


def _body(df: DataFrame) -> DataFrame:
    return df.filter(F.col(BODY) == 1).drop(BODY, BUCKET)


def fill(df: DataFrame, keys: list[str], order: list[str], cols: list[str], forward: bool = True, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Forward (or backward) fill of the named columns within keys, in the given total order."""
    rows = with_order_buckets(df, order, target_rows)
    direction = F.asc if forward else F.desc
    pick = F.max_by if forward else F.min_by
    at = F.struct(*order)
    ends = rows.groupBy(*keys, BUCKET).agg(*[pick(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols])
    before = Window.partitionBy(*keys).orderBy(direction(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, BUCKET, *[F.last(c, ignorenulls=True).over(before).alias(c) for c in cols])
    w = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(F.asc(BODY), *[direction(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = _join_carry(rows, carry).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    return _body(filled)


def neighbour(
    df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str], following: bool = False, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """``lag`` (or ``lead``) by one row: ``cols`` maps source columns to the names of the neighbour's values."""
    rows = with_order_buckets(df, order, target_rows)
    direction = F.desc if following else F.asc
    pick = F.min_by if following else F.max_by
    edge = rows.groupBy(*keys, BUCKET).agg(pick(F.struct(*cols), F.struct(*order)).alias("__edge"))
    chain = Window.partitionBy(*keys).orderBy(direction(BUCKET))
    carry = edge.select(*keys, BUCKET, F.lag("__edge").over(chain).alias("__edge")).select(*keys, BUCKET, "__edge.*")
    w = Window.partitionBy(*keys, BUCKET).orderBy(F.asc(BODY), *[direction(o) for o in order])
    return _body(_join_carry(rows, carry).withColumns({new: F.lag(c).over(w) for c, new in cols.items()}))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Running total of ``value`` within keys."""
    rows = with_order_buckets(df, order, target_rows)
    totals = rows.groupBy(*keys, BUCKET).agg(F.sum(value).alias(value))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, BUCKET, F.sum(value).over(before).alias(value))
    w = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(F.asc(BODY), *[F.asc(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return _body(_join_carry(rows, carry).withColumn(name, F.sum(value).over(w)))


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Zero-based position in the global order, from one range sort and per-partition offsets.

    The sorted rows are written to the checkpoint folder, since positions must not move between the
    count of a partition and its use.
    """
    mid = F.monotonically_increasing_id()
    rows = cut_lineage(df.orderBy(*order).withColumn("__mid", mid))
    rows = rows.withColumn("__part", F.shiftright("__mid", 33)).withColumn("__pos", F.col("__mid").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition of the sort
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (
        rows.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__off") + F.col("__pos"))
        .drop("__part", "__pos", "__mid", "__off")
    )


def rolling_activity(events: DataFrame, keys: list[str], ts: str, value: str, days: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """Trailing count, sum, mean, min and max over whole days per key.

    Rows are first combined per key and day on the map side, so a window group has one row per day.
    """
    daily = events.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.count(value).alias("n"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    for d in days:
        w = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-(d - 1), 0)
        total, rows = F.sum("s").over(w), F.sum("n").over(w)
        daily = daily.withColumns(
            {
                f"count_{d}d": rows,
                f"sum_{d}d": total,
                f"mean_{d}d": F.try_divide(total, rows.cast("double")),
                f"min_{d}d": F.min("lo").over(w),
                f"max_{d}d": F.max("hi").over(w),
            }
        )
    return daily.drop("n", "s", "lo", "hi")


def months_ago(df: DataFrame, keys: list[str], ts: str, value: str, months: int = 3) -> DataFrame:
    """Monthly mean per key beside the mean of the month ``months`` earlier (null where that month has none)."""
    month = F.year(ts) * 12 + F.month(ts)
    monthly = df.groupBy(*keys, month.alias("month_index")).agg(F.avg(value).alias("current"))
    w = Window.partitionBy(*keys).orderBy("month_index").rangeBetween(-months, -months)
    return monthly.withColumn("earlier", F.max("current").over(w)).withColumn("delta", F.col("current") - F.col("earlier"))
