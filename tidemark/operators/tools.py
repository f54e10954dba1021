"""Named operators that callers register and run by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Toolbox:
    """Tools of an agent: a name and a function of Columns to one aggregate Column, all run in one pass over a table.

    A name can be registered once; asking for an unknown one raises and names the known ones.
    """

    def __init__(self) -> None:
        self._tools: dict[str, Callable[[], Column]] = {}

    def add(self, name: str, tool: Callable[[], Column]) -> Toolbox:
        if name in self._tools:
            raise ValueError(f"tool {name} registered twice")
        self._tools[name] = tool
        return self

    def names(self) -> list[str]:
        return sorted(self._tools)

    def run(self, df: DataFrame, names: Iterable[str], by: list[str] | None = None) -> DataFrame:
        """``(by..., tool, value)``: the named tools over each group, from one aggregation."""
        names, by = list(names), by or []
        unknown = [n for n in names if n not in self._tools]
        if unknown:
            raise KeyError(f"unknown tools {unknown}; known: {', '.join(self.names())}")
        if not names:
            raise ValueError("no tool named")
        results = [self._tools[n]().cast("double").alias(f"__tool{i}") for i, n in enumerate(names)]
        table = df.groupBy(*by).agg(*results)
        rows = [F.struct(F.lit(n).alias("tool"), F.col(f"__tool{i}").alias("value")) for i, n in enumerate(names)]
        return table.select(*by, F.inline(F.array(*rows)))
