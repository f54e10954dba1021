"""Column profiles: numeric, categorical, correlation, quality score, feature suggestions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.columns import as_double, categorical_columns, datetime_columns, missing, numeric_columns
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.validate import pct


PAIRS_AT_ONCE = 200  # wider aggregates fall out of code generation


def profile_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per numeric column; every statistic but the quantiles comes from one aggregate."""
    cols = cols or numeric_columns(df)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        v = as_double(df, c)
        aggs += [
            F.count(v).alias(f"count_{i}"),
            F.avg(v).alias(f"mean_{i}"),
            F.stddev_samp(v).alias(f"std_{i}"),
            F.min(v).alias(f"min_{i}"),
            F.max(v).alias(f"max_{i}"),
        ]
    rows = []
    for i, c in enumerate(cols):
        lost = F.col("rows") - F.col(f"count_{i}")
        stats = [F.col(f"{s}_{i}").alias(s) for s in ("count", "mean", "std", "min", "max")]
        quant = [F.lit(v).cast("double").alias(k) for k, v in zip(("q25", "q50", "q75"), q[c])]
        rows.append(F.struct(F.lit(c).alias("column"), *stats, *quant, lost.alias("missing"), pct(lost, F.col("rows")).alias("missing_percent")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value, n)`` for every distinct non-null value; one pass for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values per column; the rank limit is applied before the shuffle."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    counts = value_counts(df, cols or categorical_columns(df))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def profile_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per text column: count, distinct, top value and its frequency, missing."""
    cols = cols or categorical_columns(df)
    # min over (-n, value): the most frequent value, the smallest of equally frequent ones
    per_value = value_counts(df, cols).withColumn("neg", -F.col("n"))
    best = F.min(F.struct(F.col("neg"), F.col("value")))
    per_column = per_value.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("best")
    )
    lost = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    base = lost.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), pct(F.col(f"m{i}"), F.col("rows")).alias("missing_percent"))
                    for i, c in enumerate(cols)
                ]
            )
        )
    )
    return base.join(per_column, "column", "left").select(
        "column",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("unique", F.lit(0)).alias("unique"),
        F.col("best.value").alias("top"),
        F.coalesce(-F.col("best.neg"), F.lit(0)).alias("freq"),
        "missing",
        "missing_percent",
    )


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation; null (not an error) when either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


def correlations(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Column pairs with |r| above the threshold; one aggregate per ``PAIRS_AT_ONCE`` pairs."""
    cols = cols or numeric_columns(df)
    every = list(combinations(cols, 2))
    if not every:
        return df.sparkSession.createDataFrame([], "left_column string, right_column string, correlation double")
    parts = [_correlated(df, every[i : i + PAIRS_AT_ONCE], threshold) for i in range(0, len(every), PAIRS_AT_ONCE)]
    return reduce(DataFrame.unionByName, parts)


def _correlated(df: DataFrame, pairs: list[tuple[str, str]], threshold: float) -> DataFrame:
    one = df.agg(*[pearson(as_double(df, a), as_double(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"r{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.inline(F.array(*rows))).filter(F.abs("correlation") > F.lit(threshold))


def clean_score(df: DataFrame) -> DataFrame:
    """``(rows, missing, clean_score)`` with score = 100 - percent of empty cells."""
    cells = F.count(F.lit(1)) * len(df.columns)
    lost = F.lit(0).cast("bigint")
    for c in df.columns:
        lost = lost + F.count_if(missing(df, c))
    return df.agg(F.count(F.lit(1)).alias("rows"), lost.alias("missing"), cells.alias("cells")).select(
        "rows", "missing", F.round(F.lit(100.0) - pct(F.col("missing"), F.col("cells")), 2).alias("clean_score")
    )


def quality_score(df: DataFrame) -> DataFrame:
    """One row: overview counts and the score 100 - missing% - 10 * duplicate share, held to 0..100.

    Rows are first collapsed into (distinct row, copies), so missing cells and duplicates come from
    the same shuffle.
    """
    lost = F.lit(0)
    for c in df.columns:
        lost = lost + missing(df, c).cast("int")
    grouped = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n")).select("__n", lost.alias("__lost"))
    one = grouped.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("__lost") * F.col("__n")), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    cells = F.col("total_rows") * len(df.columns)
    raw = (
        F.lit(100.0)
        - pct(F.col("missing_values"), cells)
        - F.coalesce(F.try_divide(F.col("duplicate_rows") * F.lit(10.0), F.col("total_rows").cast("double")), F.lit(0.0))
    )
    return one.select(
        "*",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).cast("bigint").alias("categorical_columns"),
        F.lit(len(datetime_columns(df))).cast("bigint").alias("datetime_columns"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).alias("quality_score"),
    )


def suggest_features(df: DataFrame, target: str) -> DataFrame:
    """Suggestion rows ``(kind, detail)`` from the schema and one null-count aggregate."""
    numeric = [c for c in numeric_columns(df) if c != target]
    text = categorical_columns(df)
    fixed = []
    if len(numeric) > 1:
        fixed.append(F.struct(F.lit("interaction_features").alias("kind"), F.lit(f"{numeric[0]} x {numeric[1]}").alias("detail")))
    if text:
        fixed.append(F.struct(F.lit("one_hot_encoding").alias("kind"), F.lit(", ".join(text[:3])).alias("detail")))
    if not fixed:
        fixed.append(F.struct(F.lit("standardization").alias("kind"), F.lit("scale numeric features").alias("detail")))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    named = F.filter(
        F.array(*[F.when(F.col(f"m{i}") > 0, F.lit(c)) for i, c in enumerate(df.columns)]), lambda x: x.isNotNull()
    )
    impute = F.struct(F.lit("impute").alias("kind"), F.array_join(named, ", ").alias("detail"))
    kfold = F.struct(F.lit("k_fold").alias("kind"), F.when(F.col("n") < 1000, "small dataset").otherwise("").alias("detail"))
    return one.select(F.inline(F.array(*fixed, impute, kfold))).filter("detail <> ''")
