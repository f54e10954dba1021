"""Named queries: each has a Spark function and, where SQL can say the same, a reference SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


class Tables:
    """Lazy access to the input tables and the derived views: ``t.lineitem``, ``t.locations``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in views.VIEWS:
            text, inputs = views.VIEWS[name]
            return self.spark.sql(text.format(**{i: "{" + i + "}" for i in inputs}), **{i: getattr(self, i) for i in inputs})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the view definitions it needs."""
    ctes = []
    for name in names:
        text, inputs = views.VIEWS[name]
        ctes.append(f"{name} AS ({text.format(**{i: i for i in inputs})})")
    if not ctes:
        return sql
    body = sql.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[14:]
    if body[:4].upper() == "WITH":
        return "WITH " + ", ".join(ctes) + ", " + body[4:]
    return "WITH " + ", ".join(ctes) + " " + body


def query(name: str, ops: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``ops`` lists the operator ids it covers."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        OPERATORS[name] = ops
        if sql is not None:
            SQL[name] = with_views(sql, *uses)
        return fn

    return register
