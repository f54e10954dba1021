"""Mixing sources to target weights by capped water-filling.

The budget is shared by weight; a source whose share exceeds ``max_epochs`` times its size is clamped there, and
what it can't take is shared again among the others, until no share exceeds its cap. A source then takes each
document a whole number of times, and part of its documents once more: documents follow in the order of a
seeded hash until the fractional repetition is used up, and the document at the end of it gives the words that are still missing.
A source thus takes its rounded target exactly.

Sizes are counted once and written (ids, sources and sizes only). The sources, however many, are ranked by a range
sort, and each filling round is one sum over them. Where the fractional repetition ends is found by two rounds of sums
per source and hash prefix (4096 each), so a hot source is never ranked as a whole: only the documents of one
prefix of 24 bits are.

Defined results: null text has size 0; the null source is one source, ranked last; sources rank by code point; equal
hashes (repeated ids) are ordered by size; a source of size 0 takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import free_names, text_of, words
from tidemark.operators.windows import global_index
from tidemark.session import cut_lineage

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
DIGITS = 3


def place(seed: str = SEED) -> Column:
    """Seeded place of a document in its source's order."""
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def sizes(docs: DataFrame) -> DataFrame:
    return cut_lineage(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words(text_of())).cast("bigint").alias("size")))


def source_weights(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, weight``: weights repeat along the sources in code-point order, null last."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__null", F.col("source").isNull())
    ranked = global_index(totals, ["__null", "source"], "__rank").drop("__null")
    listed = F.array(*[F.lit(w).cast("bigint") for w in weights])
    return ranked.withColumn("weight", F.get(listed, F.pmod("__rank", F.lit(len(weights))).cast("int"))).drop("__rank")


def water_fill(sources: DataFrame, budget: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: shares of the budget by weight, clamped at ``max_epochs`` times the source's size."""
    cap, rate, clamped = F.col("source_size") * max_epochs, None, -1
    while True:
        over = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) > cap
        r = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if r[0] == clamped or not r[2]:
            break
        clamped, rate = r[0], float(budget - (r[1] or 0)) / float(r[2])
    share = F.col("weight") * F.lit(rate or 0.0)
    return sources.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share).cast("double"))


def plan(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per source: target, whole repetitions, and where the fractional one ends.

    ``cut`` is the hash prefix in which it ends (null: there is none), ``left`` the words still to take there.
    """
    budget = rows.agg(F.sum("size")).first()[0] or 0
    filled = cut_lineage(water_fill(cut_lineage(source_weights(rows, weights)), budget, max_epochs))
    quota = F.floor(F.col("target") + 0.5)
    safe = F.greatest("source_size", F.lit(1))
    params = filled.withColumns({"whole": F.floor(quota / safe).cast("bigint"), "left": F.pmod(quota, safe).cast("bigint"), "cut": F.lit("")})
    keyed = rows.select("source", "size", place(seed).alias("__place"))
    for level in (1, 2):
        step = F.substring("__place", 1, level * DIGITS).alias("prefix")
        near = params.select(F.col("source").alias("s"), "left", "cut")
        part = keyed.select("source", "size", step).join(
            near, F.col("source").eqNullSafe(F.col("s")) & (F.substring("prefix", 1, (level - 1) * DIGITS) == F.col("cut"))
        )
        sums = part.groupBy("s", "prefix", "left").agg(F.sum("size").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = sums.withColumn("before", before).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
        ends = ends.select("s", F.col("prefix").alias("at"), (F.col("left") - F.col("before")).alias("rest"))
        params = cut_lineage(
            params.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "weight", "target", "whole", F.col("rest").alias("left"), F.col("at").alias("cut")
            )
        )
    return params


def assign(rows: DataFrame, params: DataFrame, seed: str = SEED) -> DataFrame:
    """Each document with ``repeats`` (whole copies) and ``partial`` (words of one more copy)."""
    p = params.withColumnRenamed("source", "s")
    at = F.substring("__place", 1, 2 * DIGITS)
    all_ = rows.withColumn("__place", place(seed)).join(p, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("__at", at)
    edge = F.coalesce(F.col("__at") == F.col("cut"), F.lit(False))
    rest = all_.filter(~edge).withColumn("partial", F.when(F.col("__at") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("bigint")))
    w = Window.partitionBy("source").orderBy("__place", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(w), F.lit(0))
    last = all_.filter(edge).withColumn("partial", F.least("size", F.greatest(F.col("left") - before, F.lit(0))).cast("bigint"))
    both = rest.unionByName(last)
    return both.select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("partial")).alias("taken"),
        "source", F.col("whole").alias("repeats"), "partial",
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    rows = sizes(docs)
    return assign(rows, plan(rows, weights, max_epochs, seed), seed)


def repeated(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the last partial copy of a source is rounded to whole documents."""
    rows = sizes(docs)
    taken = plan(rows, weights, max_epochs, seed)
    edges = assign(rows.withColumn("__e", place(seed)).join(
        taken.select(F.col("source").alias("__s"), F.col("cut").alias("__c")),
        F.col("source").eqNullSafe(F.col("__s")) & (F.substring("__e", 1, 2 * DIGITS) == F.col("__c")),
    ).select("doc_id", "source", "size"), taken, seed)
    more = edges.groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__es")).agg(
        (F.sum("partial") * 2 >= F.greatest(F.sum("size"), F.lit(1))).alias("__more")
    )
    of, whole, cut, last, copy, id_, more_of = free_names(docs.columns, "of", "whole", "cut", "last", "copy", "id", "more_of")
    p = taken.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("cut").alias(cut))
    out = docs.join(p, F.col("source").cast("string").eqNullSafe(F.col(of)))
    more = more.select(F.col("__d").alias(id_), F.col("__es").alias(more_of), F.col("__more").alias(last))
    out = out.join(more, F.col("doc_id").eqNullSafe(F.col(id_)) & F.col(of).eqNullSafe(F.col(more_of)), "left")
    early = F.substring(place(seed), 1, 2 * DIGITS) < F.col(cut)
    copies = F.col(whole) + F.when(F.coalesce(early, F.lit(False)) | F.coalesce(last, F.lit(False)), 1).otherwise(0)
    out = out.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("bigint"), copies)).otherwise(F.array().cast("array<bigint>"))))
    return out.select(*docs.columns)
