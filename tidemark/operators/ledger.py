"""Hash-chained ledger: every row holds the output hash of the row before it in its chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import evidence_hash
from tidemark.operators.windows import neighbour


def chain(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``prev_hash``; the first row of a chain has none."""
    return neighbour(rows, keys, order, {"output_hash": "prev_hash"})


def verify(ledger: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add the hash the chain calls for and whether the stored one equals it."""
    out = neighbour(ledger, keys, order, {"output_hash": "expected_hash"})
    return out.withColumn("valid", F.col("prev_hash").eqNullSafe(F.col("expected_hash")))


def entries(rows: DataFrame, payload: list[str], result: list[str]) -> DataFrame:
    """Input and output hashes of scored rows, ready to be chained."""
    return rows.withColumn("input_hash", evidence_hash({c: F.col(c) for c in payload})).withColumn(
        "output_hash", evidence_hash({c: F.col(c) for c in (*payload, *result)})
    )
