"""Registered queries of this package, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bitslice, bpe, chat, langid, licenses, mixing, ngram_join, periodic, pii, quality_classifier, quality_rules, recompress, resample
from tidemark.llm.words import text_of, words

SAID = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = quality_rules.ngram_weights(docs, quality_rules.trusted_ids(_table(spark, sf_dir, "labels")))
    return quality_rules.score(docs, weights)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.sql(f"SELECT CAST(-1 AS LONG) AS conv_id, turn, role, '{SAID}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS said(turn, role)")
    return chat.digests(chat.examples(turns.unionByName(said)))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(_table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def _planted(docs: DataFrame) -> DataFrame:
    """Documents whose id has a checksum divisible by 10 repeat a block of their words from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", text_of().alias("text"), h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    rows = rows.withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)").cast("int"))
    left = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    text = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left))
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.find(_planted(_table(spark, sf_dir, "documents"))).withColumn("best", periodic.strongest("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.mark(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_ngram_join, op3_quality_classifier, op4_mixing, op5_licenses,
        op6_language, op7_pii, op8_chat, op9_topk, op10_bpe,
        op11_periodic_runs, op12_substring_dedup, op13_resample,
    )
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_NGRAM_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

_MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
c AS (SELECT *, sum(3 * source_size) OVER o AS clamped, sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS open_weight,
    lead(3.0 * source_size / weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS next_full
  FROM r WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST)),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS total, sum(weight) AS weights, min(3.0 * source_size / weight) AS first_full FROM r),
rate AS (
  SELECT arg_min(rate, next_full) AS rate FROM (
    SELECT CAST(total AS DOUBLE) / CAST(weights AS DOUBLE) AS rate, first_full AS next_full FROM total
    UNION ALL SELECT CAST(total - clamped AS DOUBLE) / CAST(open_weight AS DOUBLE), next_full FROM c, total WHERE open_weight > 0
  ) WHERE rate <= next_full * (1 + 1e-12)
),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * rate) AS target FROM r, rate),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) // greatest(source_size, 1) AS whole, CAST(floor(target + 0.5) AS BIGINT) % greatest(source_size, 1) AS rest FROM t),
o AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.rest,
    coalesce(sum(d.size) OVER (PARTITION BY q.source ORDER BY md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(size, greatest(rest - before, 0)) AS BIGINT) AS taken FROM o
"""


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(' '.join(licenses.template_words(text)))})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    pairs = lambda w: f"[{w}[i] || ' ' || {w}[i + 1] FOR i IN range(1, len({w}))]"
    return rf"""
WITH known AS (SELECT t, name, len(w) - 1 AS span, list_distinct({pairs("w")}) AS grams FROM (SELECT t, name, string_split(said, ' ') AS w FROM (VALUES {rows}) v(t, name, said))),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(lower(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM documents),
g AS MATERIALIZED (SELECT r, {pairs("w")} AS g FROM d),
x AS (SELECT DISTINCT r, unnest(g) AS x FROM g),
y AS (SELECT t, len(grams) AS b, unnest(grams) AS x FROM known),
near AS (SELECT r, t FROM x JOIN y USING (x) GROUP BY r, t, b HAVING 3 * count(*) >= 2 * b),
s AS (SELECT r, t, name, grams, span, unnest(range(greatest(len(g) - span, 0) + 1)) AS start FROM near JOIN known USING (t) JOIN g USING (r)),
m AS (SELECT r, name, start, len(grams) AS b, list_distinct(g[start + 1 : start + span]) AS win, grams FROM s JOIN g USING (r)),
c AS (SELECT r, name, start, len(list_intersect(win, grams)) AS shared, len(win) + b AS sizes FROM m),
f AS (SELECT *, 2.0::DOUBLE * shared / sizes AS dice FROM c WHERE 20 * shared >= 8 * sizes),
best AS (SELECT * FROM f QUALIFY rank() OVER (PARTITION BY r ORDER BY shared DESC, dice DESC) = 1),
said AS (SELECT r, max(dice) AS dice, min(start) AS start, min(name) AS low, max(name) AS high, string_agg(DISTINCT name, ',' ORDER BY name) AS candidates FROM best GROUP BY r)
SELECT doc_id, CASE WHEN low = high THEN low END AS license, coalesce(dice, 0.0::DOUBLE) AS dice, coalesce(candidates, '') AS candidates, CAST(start AS BIGINT) AS start
FROM d LEFT JOIN said USING (r)
"""


def _escaped_sql(text: str) -> str:
    out = rf"replace({text}, '\', '\b')"
    for control, sign in chat.CONTROL:
        out = f"replace({out}, '{control}', '{sign}{control[1:]}')"
    return out


_CHAT_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'
), e AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({len(chat.OPEN) + 1 + len(chat.CLOSE)} + length(replace({_escaped_sql("role")}, chr(10), '\n')) + length({_escaped_sql("text")})) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_CRC_SQL = """
WITH RECURSIVE step AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8)"""


def _crc_sql(text: str) -> str:
    octets = f"[CAST('0x' || hex(encode({text}))[2 * j - 1 : 2 * j] AS BIGINT) FOR j IN range(1, length(hex(encode({text}))) // 2 + 1)]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_RUNS_SQL = rf"""{_CRC_SQL},
ids AS (SELECT k, {_crc_sql("k")} AS h FROM (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents), crc),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
e AS (SELECT d.*, h, h // 10 AS g, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM d JOIN ids ON k = coalesce(CAST(doc_id AS VARCHAR), '')),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], [w[a + 1 + i % p] FOR i IN range(n - a)]) ELSE w END AS w FROM f),
x AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
same AS (SELECT a.r, b.i - a.i AS p, a.i FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 3),
isle AS (SELECT r, p, min(i) AS s, count(*) AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM same) GROUP BY r, p, k),
runs AS (SELECT r, s, size + p AS len, min(p) AS p FROM isle WHERE size >= greatest(24 - p, 2 * p) GROUP BY r, s, size + p),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(len AS DOUBLE) / p DESC, s, p) AS turn FROM runs),
said AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS said FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + p, s + len)) AS i FROM runs),
kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN gone ON gone.r = x.r AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(p AS BIGINT) AS period,
  CAST(1000 * len // p AS BIGINT) AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN said USING (r) LEFT JOIN (SELECT * FROM best WHERE turn = 1) USING (r) LEFT JOIN kept USING (r)
"""

_REPEATS_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT r, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM (SELECT r, w, unnest(range(len(w) - 34)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM x) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM twice),
p AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
kept AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN gone ON gone.r = p.r AND gone.i = p.i WHERE gone.i IS NULL GROUP BY p.r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""

_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_RESAMPLE_SQL = rf"""{_CRC_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS w FROM documents),
x AS (SELECT r, unnest(w) AS word FROM d),
y AS (SELECT unnest({_FEATURES}) AS word FROM benchmark),
marks AS (SELECT word, {_crc_sql("word")} % 10000 AS b FROM (SELECT word FROM x UNION SELECT word FROM y), crc),
raw AS (SELECT b, count(*) AS s FROM x JOIN marks USING (word) GROUP BY b),
target AS (SELECT b, count(*) AS t FROM y JOIN marks USING (word) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM x) + 10000 AS s_all, (SELECT count(*) FROM y) + 10000 AS t_all),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * s_all AS DOUBLE) / CAST((s + 1) * t_all AS DOUBLE))) AS BIGINT) AS gain
  FROM raw LEFT JOIN target USING (b), total),
weight AS (SELECT r, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM x JOIN marks USING (word) JOIN gain USING (b) GROUP BY r),
s AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM d LEFT JOIN weight USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS turn,
  10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS wanted FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND turn <= wanted THEN turn END AS rank FROM k
"""

SQL: dict[str, str] = {
    "op2_ngram_join": _NGRAM_SQL,
    "op4_mixing": _MIX_SQL,
    "op5_licenses": _license_sql(),
    "op8_chat": _CHAT_SQL,
    "op9_topk": _TOPK_SQL,
    "op11_periodic_runs": _RUNS_SQL,
    "op12_substring_dedup": _REPEATS_SQL,
    "op13_resample": _RESAMPLE_SQL,
}
