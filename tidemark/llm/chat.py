"""Chat formatting by prefix-target expansion.

A conversation is rendered turn by turn as ``<|im_start|>role``, a line break, the text, ``<|im_end|>``
and a line break. Every assistant turn becomes an example: all turns up to it as text, and the
place of its own words as the only trainable span. Turns after the last assistant turn (or a
conversation without one) come as one more example without a trainable span, so nothing is lost.

Control strings inside texts are escaped reversibly: a backslash becomes ``\\b``, and the first sign of a
control string becomes ``\\l`` (for ``<``) or ``\\s`` (for ``[``); in role names a line break becomes ``\\n``.

All Column expressions. Rows are shuffled once, by conversation; the number of rows stays linear in the
turns. One conversation is one value (its digests need it whole), so it must fit a row.

Defined results: null text or role counts as empty; turns with equal numbers (null first) are ordered by
role, then text; a null ``conv_id`` is a conversation of its own; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates, with what stands for their first sign.
CONTROL = (("<|", r"\l"), ("<s>", r"\l"), ("</s>", r"\l"), ("<<SYS>>", r"\l"), ("<</SYS>>", r"\l"), ("[INST]", r"\s"), ("[/INST]", r"\s"))
TURN = r"<\|im_start\|>([^\n]*)\n([\s\S]*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit(r"\b"))
    for control, sign in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(sign + control[1:]))
    return out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(r"\l"), F.lit("<")), F.lit(r"\s"), F.lit("["))
    return F.replace(out, F.lit(r"\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(r"\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(r"\n"), F.lit("\n")))


def examples(turns: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end`` (code points, end exclusive; null without a trainable span)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").alias("__turn"), role.alias("__role"), text.alias("__text"))
    body = escape(F.col("__text"))
    rows = rows.withColumns({
        "__segment": F.concat(F.lit(OPEN), escape_role(F.col("__role")), F.lit("\n"), body, F.lit(CLOSE)),
        "__body": F.length(body).cast("bigint"),
    })
    w = Window.partitionBy("conv_id").orderBy("__turn", "__role", "__text")
    upto = F.sum(F.length("__segment")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"__pos": F.row_number().over(w), "__end": upto})
    item = F.struct("__pos", "__segment", "__end", "__body", (F.col("__role") == "assistant").alias("__target"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("__items"))
    whole = F.array_join(F.transform("__items", lambda x: x["__segment"]), "")
    ends = F.transform("__items", lambda x: F.struct(x["__pos"].alias("pos"), x["__end"].alias("end"), x["__body"].alias("body"), x["__target"].alias("target")))
    chosen = F.filter(ends, lambda x: x["target"] | (x["pos"] == F.size("__items")))
    rows = convs.select("conv_id", whole.alias("__whole"), F.inline(chosen))
    loss_end = F.when(F.col("target"), F.col("end") - len(CLOSE))
    return rows.select(
        "conv_id",
        F.col("pos").alias("example"),
        F.substring("__whole", F.lit(1), F.col("end").cast("int")).alias("text"),
        (loss_end - F.col("body")).alias("loss_start"),
        loss_end.alias("loss_end"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text and sizes."""
    cut = F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = formatted.withColumn("__loss", unescape(F.coalesce(cut, F.lit(""))))
    convs = rows.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("__whole"),
        F.sort_array(F.collect_list(F.struct("example", "__loss"))).alias("__losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    convs = convs.withColumns({
        "__roles": F.regexp_extract_all("__whole", F.lit(TURN), F.lit(1)),
        "__texts": F.regexp_extract_all("__whole", F.lit(TURN), F.lit(2)),
        "__loss": F.array_join(F.transform("__losses", lambda x: x["__loss"]), ""),
    })
    said = F.zip_with("__roles", "__texts", lambda r, t: F.concat(unescape_role(r), F.lit("\n"), unescape(t), F.lit("\n")))
    return convs.select(
        "conv_id",
        F.size("__roles").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("__loss").cast("bigint").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
