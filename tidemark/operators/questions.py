"""Batch answering of questions: route, retrieve, predict, collect evidence, phrase the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing, text
from tidemark.operators.vector import topk_cosine
from tidemark.session import cut_lineage


def retrieve(questions: DataFrame, documents: DataFrame, k: int = 5, min_similarity: float = 0.3) -> DataFrame:
    """Top documents per question from the vector table its domain uses.

    The four tables hold different documents, so each is scanned once, for its own questions.
    """
    parts = []
    for table in sorted(set(text.DOMAIN_TABLE.values())):
        mine = questions.filter(F.col("vector_table") == table).select("query_id", "embedding")
        parts.append(topk_cosine(mine, documents.filter(F.col("vector_table") == table).select("id", "embedding"), k, min_similarity))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def answer(questions: DataFrame, documents: DataFrame, predict: Callable[[DataFrame], DataFrame], k: int = 5, min_similarity: float = 0.3) -> DataFrame:
    """One row per question with domain, evidence hash and answer.

    ``questions`` has ``query_id, query, embedding``; ``predict`` adds ``label, confidence, severity`` and the
    map ``attributions``.
    """
    routed = questions.withColumn("domain", text.domain(F.col("query"))).withColumn("vector_table", text.lookup(F.col("domain"), text.DOMAIN_TABLE))
    routed = cut_lineage(routed)  # read once per vector table and again for the answers
    found = retrieve(routed, documents, k, min_similarity)
    records = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("records"), F.round(F.max("similarity"), 3).alias("best_similarity"))
    rows = predict(routed.drop("embedding").join(records, "query_id", "left").withColumn("records", F.coalesce("records", F.lit(0))))
    rows = rows.withColumn("top", text.top_attributions(F.col("attributions"), 3)).withColumn("agent", text.lookup(F.col("domain"), text.DOMAIN_AGENT))
    evidence = {
        "query_id": F.col("query_id"),
        "domain": F.col("domain"),
        "agent": F.col("agent"),
        "records": F.col("records"),
        "label": F.col("label"),
        "top_features": F.transform("top", lambda e: e["name"]),
        "data_sources": text.sources(F.col("domain")),
    }
    said = text.answer(F.col("domain"), F.col("label"), F.col("confidence"), F.col("severity"), F.col("top"), F.col("records"))
    return rows.select(
        "query_id", "domain", "agent", "records", "best_similarity", "label", hashing.evidence_hash(evidence).alias("evidence_hash"), said.alias("answer")
    )
