"""Fitted feature stages.

A stage learns its parameters with ``fit`` (aggregates on the training table) and applies them with
``transform`` as plain Column expressions or dictionary joins, so a fitted stage also runs on a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators.columns import as_double, categorical_columns, family, missing, numeric_columns
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.windows import global_index
from tidemark.session import cut_lineage

INLINE_VALUES = 200  # dictionaries up to this size become an expression
BROADCAST_VALUES = 200_000  # counted dictionaries up to this size are broadcast, larger ones joined by shuffle


class Stage:
    """Subclass and override ``fit`` and ``transform`` for a custom stage."""

    def fit(self, df: DataFrame) -> "Stage":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Chain(Stage):
    """Stages in order; each is fitted on the output of the one before and replayed on new data."""

    def __init__(self, *stages: Stage):
        self.stages = list(stages)

    def then(self, stage: Stage) -> "Chain":
        self.stages.append(stage)
        return self

    def fit(self, df: DataFrame) -> "Chain":
        for stage in self.stages:
            df = stage.fit(df).transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, stage: stage.transform(d), self.stages, df)


class Scale(Stage):
    """``standard`` (population deviation), ``minmax`` or ``robust``; a zero spread divides by one."""

    def __init__(self, strategy: str = "standard", columns: list[str] | None = None, suffix: str = ""):
        if strategy not in ("standard", "minmax", "robust"):
            raise ValueError(f"unknown strategy {strategy}")
        self.strategy, self.columns, self.suffix = strategy, columns, suffix
        self.params: dict[str, tuple[float | None, float]] = {}

    def fit(self, df: DataFrame) -> "Scale":
        cols = [c for c in (self.columns or numeric_columns(df)) if c in df.columns]
        if self.strategy == "robust":
            q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
            raw = {c: (v[1], None if v[0] is None else v[2] - v[0]) for c, v in q.items()}
        else:
            pair = (F.avg, F.stddev_pop) if self.strategy == "standard" else (F.min, F.max)
            row = df.agg(*[f(as_double(df, c)).alias(f"p{i}_{j}") for i, c in enumerate(cols) for j, f in enumerate(pair)]).first()
            raw = {c: (row[f"p{i}_0"], row[f"p{i}_1"]) for i, c in enumerate(cols)}
            if self.strategy == "minmax":
                raw = {c: (lo, None if lo is None else hi - lo) for c, (lo, hi) in raw.items()}
        self.params = {c: (center, spread or 1.0) for c, (center, spread) in raw.items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                f"{c}{self.suffix}": (as_double(df, c) - F.lit(center).cast("double")) / F.lit(spread)
                for c, (center, spread) in self.params.items()
                if c in df.columns
            }
        )


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties; one counted pass for all columns.

    Values are counted per (column, value) and then reduced, so no task holds a column's value map.
    """
    if not cols:
        return {}
    num = [family(df.schema[c].dataType) in ("int", "float") for c in cols]
    cells = [
        F.struct(
            F.lit(i).alias("i"),
            (as_double(df, c) if is_num else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if is_num else F.col(c).cast("string")).alias("txt"),
        )
        for i, (c, is_num) in enumerate(zip(cols, num))
    ]
    rows = (
        df.select(F.inline(F.array(*cells)))
        .filter("num IS NOT NULL OR txt IS NOT NULL")
        .groupBy("i", "num", "txt")
        .agg((-F.count(F.lit(1))).alias("neg"))
        .groupBy("i")
        .agg(F.min(F.struct("neg", "num", "txt")).alias("best"))
        .collect()
    )
    best = {r["i"]: r["best"] for r in rows}
    return {c: (best[i]["num"] if is_num else best[i]["txt"]) if i in best else None for i, (c, is_num) in enumerate(zip(cols, num))}


def gappy_columns(df: DataFrame) -> list[str]:
    """Columns with at least one missing value."""
    row = df.agg(*[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[i]]


class Impute(Stage):
    """``mean``, ``median``, ``mode`` or ``constant``; default columns are those with gaps at fit time."""

    def __init__(self, strategy: str = "mean", columns: list[str] | None = None, fill_value: object = None):
        if strategy not in ("mean", "median", "mode", "constant"):
            raise ValueError(f"unknown strategy {strategy}")
        self.strategy, self.columns, self.fill_value = strategy, columns, fill_value
        self.values: dict[str, object] = {}

    def fit(self, df: DataFrame) -> "Impute":
        cols = gappy_columns(df) if self.columns is None else [c for c in self.columns if c in df.columns]
        if self.strategy == "mode":
            self.values = modes(df, cols)
        elif self.strategy == "constant":
            self.values = {c: self.fill_value for c in cols}
        else:
            cols = [c for c in cols if c in numeric_columns(df)]
            if self.strategy == "median":
                self.values = {c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()}
            elif cols:
                row = df.agg(*[F.avg(as_double(df, c)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
                self.values = dict(zip(cols, row))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return fill_values(df, self.values)


def fill_values(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace gaps; a fractional fill turns an integer column into a double one."""
    out = {}
    for c, v in values.items():
        if v is None or c not in df.columns:
            continue
        dt = df.schema[c].dataType
        base = F.when(~missing(df, c), F.col(c))
        if family(dt) == "int" and isinstance(v, float) and not v.is_integer():
            out[c] = F.coalesce(base.cast("double"), F.lit(v))
        else:
            out[c] = F.coalesce(base, F.lit(v).cast(dt))
    return df.withColumns(out) if out else df


class FillMissing(Impute):
    """Median for numbers, most frequent value (or ``Unknown``) for everything else."""

    def __init__(self):
        super().__init__("mode")

    def fit(self, df: DataFrame) -> "FillMissing":
        gaps = gappy_columns(df)
        num = [c for c in numeric_columns(df) if c in gaps]
        rest = [c for c in gaps if c not in num]
        self.values = {c: q[0] for c, q in exact_quantiles(df, num, [0.5]).items()}
        self.values.update({c: "Unknown" if v is None else v for c, v in modes(df, rest).items()})
        return self


def distinct_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``(__column, __value)`` of all distinct non-null texts, written once."""
    cells = F.array(*[F.struct(F.lit(c).alias("__column"), v.cast("string").alias("__value")) for c, v in values.items()])
    return cut_lineage(df.select(F.inline(cells)).filter("__value IS NOT NULL").distinct())


class Dictionary:
    """Sorted distinct values of a text column with their index.

    Small dictionaries become an array expression; larger ones a table that is broadcast up to a counted
    limit and joined by shuffle beyond it.
    """

    def __init__(self, distinct: DataFrame, size: int):
        self.size = size
        self.values: list[str] | None = None
        self.table: DataFrame | None = None
        if size <= INLINE_VALUES:
            self.values = [r[0] for r in distinct.orderBy("__value").collect()]
        else:
            self.table = global_index(distinct, ["__value"], "__index").withColumn("__index", F.col("__index").cast("int"))

    @classmethod
    def fit_all(cls, df: DataFrame, values: dict[str, Column]) -> dict[str, "Dictionary"]:
        """Dictionaries of several columns from one pass over the table."""
        found = distinct_values(df, values)
        sizes = {r["__column"]: r["n"] for r in found.groupBy("__column").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {c: cls(found.filter(F.col("__column") == c).select("__value"), sizes.get(c, 0)) for c in values}

    def index(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """Add the index of ``value`` as ``name``; null where the value is not in the dictionary."""
        if self.values is not None:
            known = F.array(*[F.lit(v) for v in self.values]) if self.values else F.array().cast("array<string>")
            return df.withColumn(name, F.nullif(F.array_position(known, value).cast("int"), F.lit(0)) - 1)
        table = self._sized()
        return (
            df.withColumn("__value", value)
            .join(table, "__value", "left")
            .withColumn(name, F.col("__index"))
            .drop("__value", "__index")
        )

    def value(self, df: DataFrame, index: str, name: str) -> DataFrame:
        """Inverse lookup."""
        if self.values is not None:
            return df.withColumn(name, F.get(F.array(*[F.lit(v) for v in self.values]), F.col(index).cast("int")))
        table = self._sized().withColumnsRenamed({"__value": name, "__index": index})
        kept = [c for c in df.columns if c != name]
        return df.drop(name).join(table, index, "left").select(*kept, name)

    def _sized(self) -> DataFrame:
        return F.broadcast(self.table) if self.size <= BROADCAST_VALUES else self.table


class LabelEncode(Stage):
    """Index of the text form in sorted order; ``unseen`` is ``"error"`` or the code for unknown values."""

    def __init__(self, columns: list[str] | None = None, unseen: object = "error", suffix: str = "", null_token: str = "nan"):
        self.columns, self.unseen, self.suffix, self.null_token = columns, unseen, suffix, null_token
        self.dictionaries: dict[str, Dictionary] = {}

    def _text(self, c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(self.null_token))

    def fit(self, df: DataFrame) -> "LabelEncode":
        cols = [c for c in (self.columns or categorical_columns(df)) if c in df.columns]
        self.dictionaries = Dictionary.fit_all(df, {c: self._text(c) for c in cols}) if cols else {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for c, words in self.dictionaries.items():
            if c not in df.columns:
                continue
            text = self._text(c)
            df = words.index(df, text, "__code")
            if self.unseen == "error":
                fallback = F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), text)).cast("int")
            else:
                fallback = F.lit(self.unseen).cast("int")
            df = df.withColumn(f"{c}{self.suffix}", F.coalesce("__code", fallback)).drop("__code")
        return df


class OneHot(Stage):
    """One 0/1 column per fitted value, named ``column_value``; unseen and null give all zeros.

    A column of more than ``max_values`` values becomes ``column_index``, the place of its one (null: all zeros), the
    sparse form of the same vector.
    """

    def __init__(self, columns: list[str] | None = None, max_values: int = 1000):
        self.columns, self.max_values = columns, max_values
        self.categories: dict[str, list[str]] = {}
        self.wide: dict[str, Dictionary] = {}

    def fit(self, df: DataFrame) -> "OneHot":
        cols = self.columns or categorical_columns(df)
        found = distinct_values(df, {c: F.col(c) for c in cols})
        sizes = {r["__column"]: r["n"] for r in found.groupBy("__column").agg(F.count(F.lit(1)).alias("n")).collect()}
        wide = [c for c in cols if sizes.get(c, 0) > self.max_values]
        self.wide = {c: Dictionary(found.filter(F.col("__column") == c).select("__value"), sizes[c]) for c in wide}
        self.categories = {c: [] for c in cols if c not in wide}
        for r in found.filter(F.col("__column").isin(list(self.categories))).orderBy("__column", "__value").collect():
            self.categories[r["__column"]].append(r["__value"])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = {
            f"{c}_{v}": F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))
            for c, values in self.categories.items()
            for v in values
        }
        df = df.withColumns(out).drop(*self.categories)
        for c, dictionary in self.wide.items():
            df = dictionary.index(df, F.col(c).cast("string"), f"{c}_index").drop(c)
        return df


class TargetEncode(Stage):
    """Mean of the target per value; unseen values get the overall mean."""

    def __init__(self, column: str, target: str, suffix: str = "_target"):
        self.column, self.target, self.suffix = column, target, suffix
        self.means: DataFrame | None = None
        self.default: float | None = None

    def fit(self, df: DataFrame) -> "TargetEncode":
        self.means = cut_lineage(df.groupBy(F.col(self.column).alias("__value")).agg(F.avg(self.target).alias("__mean"), F.count(self.target).alias("__n")))
        self.size = self.means.count()
        row = self.means.agg(F.try_divide(F.sum(F.col("__mean") * F.col("__n")), F.sum("__n"))).first()
        self.default = row[0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        means = self.means.drop("__n").filter("__value IS NOT NULL")
        table = F.broadcast(means) if self.size <= BROADCAST_VALUES else means
        return (
            df.join(table, F.col(self.column) == F.col("__value"), "left")
            .withColumn(f"{self.column}{self.suffix}", F.coalesce("__mean", F.lit(self.default)))
            .drop("__value", "__mean")
        )


class Features(Stage):
    """New columns from ``{name: Column or callable(df) -> Column}``; one that fails to resolve is skipped and recorded."""

    def __init__(self, functions: dict[str, Column | Callable[[DataFrame], Column]]):
        self.functions = functions
        self.failed: dict[str, str] = {}

    def transform(self, df: DataFrame) -> DataFrame:
        for name, fn in self.functions.items():
            try:
                out = df.withColumn(name, fn(df) if callable(fn) and not isinstance(fn, Column) else fn)
                out.schema
                df = out
            except (AnalysisException, KeyError, TypeError, ValueError) as e:
                self.failed[name] = str(e).split("\n")[0]
        return df


class Polynomial(Stage):
    """Degree-two terms: squares and pairwise products as ``a^2`` and ``a*b`` columns."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for i, a in enumerate(self.columns):
            out[f"{a}^2"] = as_double(df, a) * as_double(df, a)
            for b in self.columns[i + 1 :]:
                out[f"{a}*{b}"] = as_double(df, a) * as_double(df, b)
        return df.withColumns(out)


class Preprocess(Stage):
    """Median + standard scale for numbers, label index (-1 unseen) for text and bool, target split off and indexed.

    ``transform`` adds an array column ``features`` in the order numeric then categorical, and ``label``
    where the target is present.
    """

    def __init__(self, target: str | None = None):
        self.target = target
        self.target_words: Dictionary | None = None

    def fit(self, df: DataFrame) -> "Preprocess":
        self.numeric = [c for c in numeric_columns(df) if c != self.target]
        self.categorical = [
            f.name for f in df.schema.fields if family(f.dataType) in ("string", "bool") and f.name != self.target
        ]
        self.feature_names = self.numeric + self.categorical
        filled = Impute("median", self.numeric).fit(df)
        self.numbers = Chain(filled, Scale("standard", self.numeric).fit(filled.transform(df)))
        self.labels = LabelEncode(self.categorical, unseen=-1).fit(df) if self.categorical else Chain()
        if self.target and family(df.schema[self.target].dataType) == "string":
            self.target_words = Dictionary.fit_all(df, {self.target: F.col(self.target)})[self.target]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.numbers.transform(self.labels.transform(df))
        out = out.withColumn("features", F.array(*[F.col(c).cast("double") for c in self.feature_names]))
        if self.target and self.target in df.columns:
            if self.target_words is not None:
                out = self.target_words.index(out, F.col(self.target), "label").withColumn("label", F.col("label").cast("double"))
            else:
                out = out.withColumn("label", F.col(self.target).cast("double"))
        return out

    def inverse_target(self, df: DataFrame, index: str, name: str) -> DataFrame:
        """Encoded target values back to the original labels."""
        return df.withColumn(name, F.col(index)) if self.target_words is None else self.target_words.value(df, index, name)


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One-way F statistic per feature against a class label, from one grouped aggregate."""
    per = df.groupBy(label).agg(
        *[a for i, c in enumerate(features) for a in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"))]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"n{i}").cast("double").alias("n"),
                F.col(f"m{i}").alias("m"),
                F.col(f"v{i}").alias("v"),
            )
            for i, c in enumerate(features)
        ]
    )
    stats = per.select(F.inline(cells)).groupBy("feature").agg(
        F.count_if(F.col("n") > 0).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.try_divide(F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")), F.sum("n"))).alias("between"),
    )
    score = F.try_divide(
        F.try_divide(F.col("between"), (F.col("k") - 1).cast("double")), F.try_divide(F.col("within"), F.col("n") - F.col("k"))
    )
    return stats.select("feature", score.alias("f_score"))


def mutual_information(df: DataFrame, features: dict[str, Column], label: str) -> DataFrame:
    """Mutual information (nats) of binned features with a label; ``features`` maps names to bin expressions."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), b.cast("string").alias("bin")) for n, b in features.items()])
    joint = df.select(F.col(label).alias("y"), F.inline(cells)).groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("nxy"))
    over = lambda *keys: F.sum("nxy").over(Window.partitionBy(*keys))  # null bins and labels are values like others
    j = joint.withColumns({"nx": over("feature", "bin"), "ny": over("feature", "y"), "n": over("feature")})
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")).cast("double"))
    return j.groupBy("feature").agg(F.sum(term).alias("mutual_information"))


def select_k_best(scores: DataFrame, score: str, k: int = 50) -> list[str]:
    """Names of the k best scored features (bounded by the number of columns)."""
    return [r["feature"] for r in scores.orderBy(F.desc_nulls_last(score), "feature").limit(k).collect()]
