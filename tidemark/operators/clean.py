"""Cleaning and transform operations applied from an ordered list of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.columns import as_double, datetime_columns, numeric_columns
from tidemark.operators.profile import clean_score
from tidemark.operators.quantiles import iqr_fences
from tidemark.operators.stages import FillMissing, LabelEncode, Scale
from tidemark.session import cut_lineage


def remove_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fill_missing(df: DataFrame) -> DataFrame:
    return FillMissing().fit_transform(df)


def _within(df: DataFrame, c: str, fence: tuple[float, float] | None):
    if fence is None:
        return F.lit(True)
    v = as_double(df, c)
    return F.coalesce((v >= F.lit(fence[0])) & (v <= F.lit(fence[1])), F.lit(True))


def remove_outliers(df: DataFrame, sequential: bool = True) -> DataFrame:
    """Drop rows outside the quartile fences; rows with null are kept.

    Sequential mode recomputes each column's fences on the survivors. The fences are literals, so the
    result stays one scan with a conjunction of predicates; simultaneous mode needs one fit for all columns.
    """
    cols = numeric_columns(df)
    if not sequential:
        fences = iqr_fences(df, cols)
        for c in cols:
            df = df.filter(_within(df, c, fences[c]))
        return df
    for c in cols:
        df = df.filter(_within(df, c, iqr_fences(df, [c])[c]))
    return df


def remove_zscore_outliers(df: DataFrame, threshold: float = 3.0, cols: list[str] | None = None) -> DataFrame:
    """Drop rows more than ``threshold`` population deviations from the mean in any column."""
    cols = cols or numeric_columns(df)
    row = df.agg(*[a for i, c in enumerate(cols) for a in (F.avg(as_double(df, c)).alias(f"m{i}"), F.stddev_pop(as_double(df, c)).alias(f"s{i}"))]).first()
    for i, c in enumerate(cols):
        if row[f"s{i}"]:
            z = F.abs((as_double(df, c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"]))
            df = df.filter(F.coalesce(z <= F.lit(float(threshold)), F.lit(True)))
    return df


CLEAN = {"remove_duplicates": remove_duplicates, "fill_missing": fill_missing, "remove_outliers": remove_outliers}


def clean(df: DataFrame, operations: list[str]) -> DataFrame:
    """Apply cleaning operations in order; the order matters because columns are re-read for each.

    Rows without duplicates are written once, so that what is fitted on them does not repeat the shuffle.
    """
    for k, name in enumerate(operations):
        df = CLEAN[name](df)
        if name == "remove_duplicates" and k + 1 < len(operations):
            df = cut_lineage(df)
    return df


def normalize(df: DataFrame) -> DataFrame:
    return Scale("standard", suffix="_normalized").fit_transform(df)


def encode_categorical(df: DataFrame) -> DataFrame:
    return LabelEncode(suffix="_encoded").fit_transform(df)


def create_features(df: DataFrame) -> DataFrame:
    """Product and guarded ratio of the first two numeric columns."""
    cols = numeric_columns(df)
    if len(cols) < 2:
        return df
    a, b = as_double(df, cols[0]), as_double(df, cols[1])
    return df.withColumns(
        {f"{cols[0]}_{cols[1]}_interaction": a * b, f"{cols[0]}_{cols[1]}_ratio": F.try_divide(a, b + F.lit(1e-10))}
    )


def datetime_features(df: DataFrame) -> DataFrame:
    """Year, month, day and weekday (Monday = 0) of every date column."""
    out = {}
    for c in datetime_columns(df):
        out |= {f"{c}_year": F.year(c), f"{c}_month": F.month(c), f"{c}_day": F.dayofmonth(c), f"{c}_dayofweek": F.weekday(c)}
    return df.withColumns(out) if out else df


TRANSFORM = {
    "normalize": normalize,
    "encode_categorical": encode_categorical,
    "create_features": create_features,
    "datetime_features": datetime_features,
}


def transform(df: DataFrame, operations: list[str]) -> DataFrame:
    for name in operations:
        df = TRANSFORM[name](df)
    return df


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts, gaps and scores on both sides of a cleaning run, with the improvement."""
    both = clean_score(before).withColumn("side", F.lit("before")).unionByName(clean_score(after).withColumn("side", F.lit("after")))
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    out = both.agg(
        *[pick(c, side).alias(f"{side}_{name}") for side in ("before", "after") for c, name in (("rows", "rows"), ("missing", "missing"), ("clean_score", "score"))]
    )
    return out.withColumn("improvement_percent", F.round(F.col("after_score") - F.col("before_score"), 2))
