"""Rule checks over a table, reported as flat rows ``(check, column, count, percent, status)``.

All column statistics of a report come from one fused aggregate; only the duplicate check needs a
shuffle of its own, and that one collapses equal rows on the map side first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import quantiles
from tidemark.operators.columns import as_double, dtype_name, missing, numeric_columns

REPORT = "check string, column string, count bigint, percent double, status string"


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole.cast("double")), F.lit(0.0))


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row ``(rows, duplicates)``: copies after the first, null equal to null."""
    names = cols or df.columns
    return (
        df.groupBy(*[F.col(f"`{c}`") for c in names])
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    )


def _row(check: str, column: str, count: Column, percent: Column, status: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(column).alias("column"),
        count.cast("bigint").alias("count"),
        F.round(percent, 2).alias("percent"),
        status.alias("status"),
    )


def _constant_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, REPORT)


def schema_check(df: DataFrame, expected_columns: list[str], expected_dtypes: dict[str, str]) -> list[tuple]:
    """Metadata-only rows: missing and extra columns, dtype substrings that do not match."""
    rows: list[tuple] = []
    if expected_columns:
        lost = sorted(set(expected_columns) - set(df.columns))
        extra = sorted(set(df.columns) - set(expected_columns))
        rows.append(("schema", "*", len(lost) + len(extra), 0.0, "failed" if lost or extra else "passed"))
        rows += [("schema", c, 1, 0.0, "missing_column") for c in lost] + [("schema", c, 1, 0.0, "extra_column") for c in extra]
    if expected_dtypes:
        odd = [c for c, want in expected_dtypes.items() if c in df.columns and want not in dtype_name(df.schema[c].dataType)]
        rows.append(("dtypes", "*", len(odd), 0.0, "failed" if odd else "passed"))
        rows += [("dtypes", c, 1, 0.0, "dtype_mismatch") for c in sorted(odd)]
    return rows


def validate(
    df: DataFrame,
    expected_columns: list[str] | None = None,
    expected_dtypes: dict[str, str] | None = None,
    max_missing_percent: float = 5.0,
    max_duplicate_percent: float = 1.0,
    value_ranges: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """The full report; rows with column ``*`` are the checks, the others their per-column detail."""
    ranges = {c: r for c, r in (value_ranges or {}).items() if c in numeric_columns(df)}
    numeric = numeric_columns(df)
    fences = quantiles.iqr_fences(df, numeric)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(missing(df, c)).alias(f"miss_{i}") for i, c in enumerate(df.columns)]
    for i, c in enumerate(numeric):
        v = as_double(df, c)
        out = F.lit(False) if fences[c] is None else (v < F.lit(fences[c][0])) | (v > F.lit(fences[c][1]))
        aggs.append(F.count_if(out).alias(f"out_{i}"))
    for i, (c, (lo, hi)) in enumerate(ranges.items()):
        v = as_double(df, c)
        aggs.append(F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"rng_{i}"))
    one = df.agg(*aggs)
    n = F.col("n")
    cells = n * len(df.columns)
    ok = F.lit("passed")

    miss = [F.col(f"miss_{i}") for i in range(len(df.columns))]
    all_miss = _total(miss)
    miss_pct = pct(all_miss, cells)
    status = (
        F.when(n == 0, "empty")
        .when(miss_pct > F.lit(float(max_missing_percent)), "failed")
        .when(all_miss > 0, "warning")
        .otherwise("passed")
    )
    rows = [_row("missing_values", "*", all_miss, miss_pct, status)]
    rows += [
        _row("missing_values", c, m, pct(m, n), F.when(m > 0, "has_missing").otherwise(ok)) for c, m in zip(df.columns, miss)
    ]
    outs = [F.col(f"out_{i}") for i in range(len(numeric))]
    all_out = _total(outs)
    rows.append(_row("outliers", "*", all_out, pct(all_out, n), F.when(all_out > 0, "warning").otherwise(ok)))
    rows += [_row("outliers", c, o, pct(o, n), F.when(o > 0, "has_outliers").otherwise(ok)) for c, o in zip(numeric, outs)]
    if value_ranges:
        bad = [F.col(f"rng_{i}") for i in range(len(ranges))]
        all_bad = _total(bad)
        rows.append(_row("value_ranges", "*", all_bad, pct(all_bad, n), F.when(all_bad > 0, "failed").otherwise(ok)))
        rows += [_row("value_ranges", c, b, pct(b, n), F.when(b > 0, "out_of_range").otherwise(ok)) for c, b in zip(ranges, bad)]
    report = one.select(F.inline(F.array(*rows)))

    dup = duplicate_count(df)
    d, total = F.col("duplicates"), F.col("rows")
    dup_status = (
        F.when(total == 0, "empty")
        .when(pct(d, total) > F.lit(float(max_duplicate_percent)), "failed")
        .when(d > 0, "warning")
        .otherwise("passed")
    )
    report = report.unionByName(dup.select(F.inline(F.array(_row("duplicates", "*", d, pct(d, total), dup_status)))))
    meta = schema_check(df, expected_columns or [], expected_dtypes or {})
    return report.unionByName(_constant_rows(df, meta)) if meta else report


def _total(parts: list[Column]) -> Column:
    total = F.lit(0).cast("bigint")
    for p in parts:
        total = total + p
    return total


def rollup(report: DataFrame) -> DataFrame:
    """One row: counts of passed, failed and warning checks, overall verdict, recommendations."""
    checks = report.filter(F.col("column") == "*")
    advice = (
        F.when((F.col("check") == "missing_values") & (F.col("status") == "failed"), "Missing values exceed threshold")
        .when((F.col("check") == "missing_values") & (F.col("status") == "warning"), "Handle missing values")
        .when((F.col("check") == "duplicates") & (F.col("status") == "failed"), "Remove duplicate rows")
        .when((F.col("check") == "duplicates") & (F.col("status") == "warning"), "Consider removing duplicate rows")
        .when((F.col("check") == "outliers") & (F.col("status") == "warning"), "Investigate outliers")
        .when((F.col("check") == "value_ranges") & (F.col("status") == "failed"), "Fix value range violations")
        .when((F.col("check") == "schema") & (F.col("status") == "failed"), "Fix missing or extra columns")
        .when((F.col("check") == "dtypes") & (F.col("status") == "failed"), "Fix data type mismatches")
    )
    out = checks.agg(
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
        F.count(F.lit(1)).alias("total_checks"),
        F.array_join(F.sort_array(F.collect_list(advice)), "; ").alias("recommendations"),
    )
    return out.withColumn("validation_passed", F.col("failed") == 0).withColumn(
        "recommendations", F.when(F.col("recommendations") == "", "All validation checks passed!").otherwise(F.col("recommendations"))
    )


# --- rule chain ---------------------------------------------------------------------------------


@dataclass
class Rule:
    """``bad`` is true for a violating row; null counts as no violation."""

    name: str
    level: str
    column: str
    bad: Column


@dataclass
class Validation:
    """Fluent chain of checks; every row rule of the chain is counted in one aggregate.

    Issues come back as rows ``(position, rule, column, level, count)`` in chain order; a rule without
    violations gives no row. ``custom`` takes a callable that returns such rows itself.
    """

    rules: list[Rule] = field(default_factory=list)
    uniques: list[tuple[str, float]] = field(default_factory=list)
    meta: list[Callable[[DataFrame], list[tuple[str, str, str, int]]]] = field(default_factory=list)
    customs: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    max_missing: float | None = None
    not_empty: bool = False

    def schema(self, required: list[str], types: dict[str, str] | None = None) -> "Validation":
        def check(df: DataFrame):
            lost = [("missing_column", c, "ERROR", 1) for c in required if c not in df.columns]
            odd = [
                ("dtype_mismatch", c, "WARNING", 1)
                for c, want in (types or {}).items()
                if c in df.columns and want not in dtype_name(df.schema[c].dataType)
            ]
            return lost + odd

        self.meta.append(check)
        return self

    def quality(self, max_missing_percent: float = 20.0, unique: list[str] | None = None) -> "Validation":
        self.max_missing = max_missing_percent
        self.not_empty = True
        self.uniques += [(c, 0.0) for c in unique or []]
        return self

    def coordinates(self, lat: str = "latitude", lon: str = "longitude") -> "Validation":
        self.rules.append(Rule("latitude_range", "ERROR", lat, ~F.col(lat).between(-90.0, 90.0)))
        self.rules.append(Rule("longitude_range", "ERROR", lon, ~F.col(lon).between(-180.0, 180.0)))
        return self

    def rule(self, name: str, column: str, bad: Column, level: str = "ERROR") -> "Validation":
        self.rules.append(Rule(name, level, column, bad))
        return self

    def custom(self, fn: Callable[[DataFrame], DataFrame]) -> "Validation":
        self.customs.append(fn)
        return self

    def issues(self, df: DataFrame) -> DataFrame:
        schema = "position int, rule string, column string, level string, count bigint"
        pos = 0
        meta = []
        for check in self.meta:
            for issue in check(df):
                meta.append((pos, *issue))
                pos += 1
        rules = [r for r in self.rules if r.column in df.columns]
        aggs = [F.count(F.lit(1)).alias("n")] + [F.count_if(r.bad).alias(f"r{i}") for i, r in enumerate(rules)]
        parts = []
        if self.max_missing is not None:
            aggs += [F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
            for i, c in enumerate(df.columns):
                over = pct(F.col(f"m{i}"), F.col("n")) > F.lit(float(self.max_missing))
                parts.append((pos + i, "missing_values", c, "WARNING", F.when(over, F.col(f"m{i}")).otherwise(0)))
            pos += len(df.columns)
        if self.not_empty:
            parts.append((pos, "empty", "*", "ERROR", F.when(F.col("n") == 0, 1).otherwise(0)))
            pos += 1
        parts += [(pos + i, r.name, r.column, r.level, F.col(f"r{i}")) for i, r in enumerate(rules)]
        pos += len(rules)
        out = df.sparkSession.createDataFrame(meta, schema)
        if parts:
            structs = [
                F.struct(
                    F.lit(p).alias("position"),
                    F.lit(rule).alias("rule"),
                    F.lit(c).alias("column"),
                    F.lit(level).alias("level"),
                    count.cast("bigint").alias("count"),
                )
                for p, rule, c, level, count in parts
            ]
            out = out.unionByName(df.agg(*aggs).select(F.inline(F.array(*structs))).filter("count > 0"))
        for c, _ in self.uniques:
            dup = duplicate_count(df, [c]).filter("duplicates > 0")
            out = out.unionByName(
                dup.select(
                    F.lit(pos).alias("position"),
                    F.lit("unique").alias("rule"),
                    F.lit(c).alias("column"),
                    F.lit("ERROR").alias("level"),
                    F.col("duplicates").alias("count"),
                )
            )
            pos += 1
        for fn in self.customs:
            out = out.unionByName(fn(df).withColumn("position", F.lit(pos)))
            pos += 1
        return out

    def is_valid(self, issues: DataFrame) -> DataFrame:
        """One row: valid when no ERROR issue is present."""
        return issues.agg(
            (F.count_if(F.col("level") == "ERROR") == 0).alias("is_valid"),
            F.count_if(F.col("level") == "ERROR").alias("errors"),
            F.count_if(F.col("level") == "WARNING").alias("warnings"),
        )

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows without a row-rule violation, and the others with the array of broken rules."""
        rules = [r for r in self.rules if r.column in df.columns]
        broken = F.filter(F.array(*[F.when(r.bad, F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        marked = df.withColumn("broken_rules", broken)
        return marked.filter(F.size("broken_rules") == 0).drop("broken_rules"), marked.filter(F.size("broken_rules") > 0)


def field_format_rules() -> dict[str, Callable[[str], Column]]:
    """Request-field formats: each gives the violation predicate for a column."""
    return {
        "username": lambda c: ~(F.col(c).rlike("^[A-Za-z0-9_]+$") & F.length(c).between(3, 50)),
        "iso2_country": lambda c: ~F.col(c).rlike("^[A-Za-z]{2}$"),
        "score": lambda c: ~F.col(c).between(1, 5),
        "batch_size": lambda c: F.col(c) > 1000,
    }
