"""Corpus pipeline: language, near copies, personal data, source mix, token ids.

Each stage works on all that its predecessor kept, is written as Parquet and read again as the next one's documents.
``run`` returns the encoded rows. Defined results for odd input are those of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, ngram_join, pii
from tidemark.llm.words import free_names
from tidemark.session import cut_lineage

MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, which becomes their ``lang``."""
    lang, score = free_names(docs.columns, "lang_found", "lang_score")
    rows = langid.identify(docs, names=(lang, score)).filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE))
    return rows.withColumn("lang", F.col(lang)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join; documents without words all stay."""
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document instead of its text, with digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: The stages learn models and run a tokenizer, which SQL cannot express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
