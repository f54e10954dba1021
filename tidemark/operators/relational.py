"""Filters, lookups, pages, keyed mutations and the aggregate reports over entity tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCH_FIELDS = ("name", "description", "title", "email", "username")  # fixed values: default searched fields


# --- filters and lookups --------------------------------------------------------------------------


def filter_by(df: DataFrame, ignore_unknown: bool = False, **equals) -> DataFrame:
    """Conjunction of equalities; an unknown column is an error unless ``ignore_unknown``."""
    unknown = [c for c in equals if c not in df.columns]
    if unknown and not ignore_unknown:
        raise ValueError(f"unknown columns: {unknown}")
    for c, v in equals.items():
        if c in df.columns:
            df = df.filter(F.col(c) == F.lit(v))
    return df


def live(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Rows not soft-deleted."""
    return df.filter(~F.col(flag))


def by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Batch point lookup: rows whose key is listed."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def exists(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Each wanted key with whether it is present."""
    found = df.select(key).distinct().withColumn("present", F.lit(True))
    return keys.select(key).join(found, key, "left").select(key, F.coalesce("present", F.lit(False)).alias("present"))


def search_text(df: DataFrame, text: str, fields: list[str] | None = None, order: str = "id", limit: int | None = 100) -> DataFrame:
    """Case-insensitive substring search over any of the fields; ``%`` and ``_`` act as wildcards."""
    fields = [c for c in (fields or SEARCH_FIELDS) if c in df.columns]
    if not fields:
        return df.limit(0)
    hit = df.filter(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in fields]))
    return hit if limit is None else hit.orderBy(order).limit(limit)


def since(df: DataFrame, ts: str, as_of: str, interval: str) -> DataFrame:
    """Rows not older than ``interval`` before ``as_of``; the reference instant is always a parameter."""
    return df.filter(F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {interval}"))


def in_box(lat: str, lon: str, south: float, west: float, north: float, east: float) -> Column:
    """Bounding box test; ``west > east`` wraps over the antimeridian."""
    if south > north:
        raise ValueError("max latitude must not be below min latitude")
    inside_lat = F.col(lat).between(south, north)
    if west <= east:
        return inside_lat & F.col(lon).between(west, east)
    return inside_lat & ((F.col(lon) >= west) | (F.col(lon) <= east))


def drop_sparse_columns(df: DataFrame, max_missing: float = 0.3) -> DataFrame:
    """Drop columns whose missing share is above the limit; one aggregate decides for all."""
    from tidemark.operators.columns import missing

    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if not row["n"] or row[f"m{i}"] / row["n"] <= max_missing]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def feature_vector(df: DataFrame, features: str, expected: list[str]) -> DataFrame:
    """Map column to an ordered array; a row lacking names gets them in ``missing_features`` and a null vector."""
    names = F.array(*[F.lit(n) for n in expected])
    gaps = F.array_except(names, F.coalesce(F.map_keys(features), F.array().cast("array<string>")))
    vector = F.transform(names, lambda n: F.element_at(features, n))
    return df.withColumn("missing_features", gaps).withColumn("vector", F.when(F.size(gaps) == 0, vector))


# --- pages ----------------------------------------------------------------------------------------


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in a total order (``order`` must end in a unique key); planned as a bounded top-k."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie in 1..1000")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last: object, limit: int = 100) -> DataFrame:
    """Keyset page: the next rows after ``last``; its cost does not grow with the page number."""
    rest = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit)


def history_page(df: DataFrame, ts: str, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, with the total and whether more rows follow."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = page(df, [F.desc(ts), F.asc(key)], limit, offset)
    return rows.withColumn("total", total).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


# --- joins ----------------------------------------------------------------------------------------


def merge(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match each other; clashing columns get ``_x`` and ``_y``.

    The outer form is a left join plus the unmatched right rows: both halves are join types whose hot
    keys adaptive execution can split, which it cannot do for a full outer join.
    """
    if how == "outer":
        both = merge(left, right, keys, "left")
        lone = right.join(left.select(*keys), _null_safe(right, left, keys), "left_anti")
        return both.unionByName(_suffixed(right=lone, left_columns=left.columns, keys=keys), allowMissingColumns=True)
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    lhs = left.select(*[F.col(c).alias(f"{c}_x" if c in clash else c) for c in left.columns])
    rhs = right.select(*[F.col(c).alias(f"__r_{c}" if c in keys else f"{c}_y" if c in clash else c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = lhs.join(rhs, cond, how)
    if how == "right":
        joined = joined.withColumns({k: F.col(f"__r_{k}") for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def _suffixed(right: DataFrame, left_columns: list[str], keys: list[str]) -> DataFrame:
    return right.select(*[F.col(c).alias(f"{c}_y" if c in left_columns and c not in keys else c) for c in right.columns])


def merge_all(frames: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """Left-deep merge of two or more tables."""
    if len(frames) < 2:
        raise ValueError("need at least two tables to merge")
    return reduce(lambda a, b: merge(a, b, keys, how), frames)


def merge_report(frames: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """``(input_rows, merged_rows, unmatched_rows)`` with unmatched = max(0, inputs - merged)."""
    counts = [f.agg(F.count(F.lit(1)).alias("n")) for f in frames]
    inputs = reduce(DataFrame.unionByName, counts).agg(F.sum("n"))
    merged = merge_all(frames, keys, how).agg(F.count(F.lit(1)).alias("merged_rows"))
    return merged.withColumn("input_rows", inputs.scalar()).withColumn(
        "unmatched_rows", F.greatest(F.lit(0).cast("bigint"), F.col("input_rows") - F.col("merged_rows"))
    )


def cascade_delete(children: DataFrame, deleted_parents: DataFrame, foreign_key: str, key: str) -> DataFrame:
    """Children whose parent was not deleted; a null foreign key stays."""
    gone = deleted_parents.select(F.col(key).alias("__gone")).distinct()
    return children.join(gone, F.col(foreign_key) == F.col("__gone"), "left_anti")


def insert_absent(table: DataFrame, new: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """Rows of ``new`` to append: non-empty text, key not yet stored, one row per key: the first by its columns in turn."""
    fresh = new if text is None else new.filter(F.length(text) > 0)
    rest = [c for c in new.columns if c != key]
    first = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("__first")).select(key, "__first.*") if rest else fresh.distinct()
    return first.join(table.select(key), key, "left_anti").select(*new.columns)


def execution_tree(runs: DataFrame) -> DataFrame:
    """Per run: its status and the roll-up of its children's states; a run without children has zeros."""
    kids = (
        runs.filter("parent_execution_id IS NOT NULL")
        .groupBy(F.col("parent_execution_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("children"),
            F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )
    out = runs.select("id", "agent_type", "status").join(kids, "id", "left")
    return out.na.fill(0, ["children", "completed", "failed"])


# --- keyed mutation: table in, table out -----------------------------------------------------------


def update_by_key(df: DataFrame, updates: DataFrame, key: str, fields: list[str] | None = None, keep_on_null: bool = False) -> DataFrame:
    """Overwrite the named fields of matched rows; unknown fields are ignored.

    ``keep_on_null`` keeps the stored value where the update holds null. A key that the updates hold twice is an error.
    """
    twice = updates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(key).first()
    if twice is not None:
        raise ValueError(f"the updates hold {key} {twice[0]!r} more than once")
    fields = [c for c in (fields or updates.columns) if c in df.columns and c in updates.columns and c != key]
    new = updates.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in fields])
    out = df.join(new, key, "left")
    values = {
        c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) if keep_on_null else F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c))
        for c in fields
    }
    return out.withColumns(values).select(*df.columns)


def matched_count(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    return df.join(updates.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("matched"))


def delete_by_key(df: DataFrame, keys: DataFrame, key: str, soft: bool = False) -> DataFrame:
    """Hard delete drops the rows; soft delete sets ``is_deleted``."""
    if not soft:
        return df.join(keys.select(key), key, "left_anti")
    return update_by_key(df, keys.select(key).distinct().withColumn("is_deleted", F.lit(True)), key, ["is_deleted"])


def retain(df: DataFrame, ts: str, as_of: str, days: int = 90) -> DataFrame:
    """Rows inside the retention period."""
    return since(df, ts, as_of, f"'{int(days)}' DAY")


def set_status(models: DataFrame, ids: DataFrame, status: str, as_of: str) -> DataFrame:
    """Status change of the listed models; going to production stamps ``deployed_at``."""
    hit = models.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    stamp = F.expr(f"TIMESTAMP_NTZ '{as_of}'") if status == "production" else F.col("deployed_at")
    return hit.withColumns(
        {
            "status": F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status")),
            "deployed_at": F.when(F.col("__hit"), stamp).otherwise(F.col("deployed_at")),
        }
    ).select(*models.columns)


# --- reports --------------------------------------------------------------------------------------


def latest(df: DataFrame, keys: list[str], order: list[str], status: str | None = "production") -> DataFrame:
    """The newest row per key as a map-side combinable ``max_by``; no window over a whole group."""
    rows = df if status is None else df.filter(F.col("status") == status)
    best = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.*")


def agent_metrics(runs: DataFrame, as_of: str, hours: int = 24, rollup: bool = False) -> DataFrame:
    """Totals, success rate and mean time per agent; the mean divides by all rows, as the service did."""
    recent = since(runs, "created_at", as_of, f"'{int(hours)}' HOUR")
    total = F.count(F.lit(1))
    ok = F.count_if(F.col("status") == "completed")
    grouped = recent.rollup("agent_type") if rollup else recent.groupBy("agent_type")
    out = grouped.agg(
        total.alias("total"),
        ok.alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.coalesce(F.try_divide(ok * F.lit(100.0), total.cast("double")), F.lit(0.0)), 2).alias("success_rate"),
        F.round(F.coalesce(F.try_divide(F.sum("execution_time_ms"), total.cast("double")), F.lit(0.0)), 2).alias("avg_time"),
    )
    return out.withColumn("agent_type", F.coalesce("agent_type", F.lit("all"))) if rollup else out


def system_stats(counts: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """``(metric, value)`` rows, each a conditional count of one table."""
    parts = [
        df.agg((F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias("value")).select(F.lit(name).alias("metric"), "value")
        for name, (df, cond) in counts.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def task_rollup(results: DataFrame, task: str = "task_id") -> DataFrame:
    """Per task: agents run, succeeded, failed, success rate and a summary sentence."""
    out = results.groupBy(task).agg(
        F.count(F.lit(1)).alias("total_agents"),
        F.count_if(F.col("status") == "success").alias("successful_agents"),
        F.count_if(F.col("status") == "failed").alias("failed_agents"),
    )
    partly = F.concat(
        F.lit("Task partially completed. "),
        F.col("successful_agents").cast("string"),
        F.lit("/"),
        F.col("total_agents").cast("string"),
        F.lit(" agents succeeded. Review failed agents for issues."),
    )
    fully = F.concat(
        F.lit("Task completed successfully with "),
        F.col("successful_agents").cast("string"),
        F.lit(" agents. All operations executed without errors."),
    )
    return out.withColumn("success_rate", F.col("successful_agents") / F.col("total_agents")).withColumn(
        "summary", F.when(F.col("failed_agents") > 0, partly).otherwise(fully)
    )
