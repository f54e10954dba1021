"""Validation and profiling queries."""

from pyspark.sql import functions as F

from tidemark.operators import profile, validate
from tidemark.plans.registry import query

DIRTY = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
NUMERIC = DIRTY[:6]


def _fence_ctes() -> str:
    parts = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b_{c}" for c in NUMERIC)
    return f"WITH q AS (SELECT {parts} FROM lineitem_dirty)"


def _outlier(c: str) -> str:
    return f"count(*) FILTER (WHERE {c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}))"


def _report_sql() -> str:
    miss = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS m_{c}" for c in DIRTY)
    outs = ", ".join(f"{_outlier(c)} AS o_{c}" for c in NUMERIC)
    total_m = " + ".join(f"m_{c}" for c in DIRTY)
    total_o = " + ".join(f"o_{c}" for c in NUMERIC)
    ctes = f"""{_fence_ctes()}, s AS (SELECT count(*) AS n, {miss}, {outs},
      count(*) FILTER (WHERE l_discount < 0 OR l_discount > 1) AS r_l_discount,
      count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 50) AS r_l_quantity FROM lineitem_dirty, q),
    d AS (SELECT sum(c) AS n, sum(c - 1) AS dup FROM (SELECT count(*) AS c FROM lineitem_dirty GROUP BY ALL_COLS)),
    t AS (SELECT *, {total_m} AS tm, {total_o} AS tot, r_l_discount + r_l_quantity AS tr FROM s)"""
    ctes = ctes.replace("ALL_COLS", ", ".join(DIRTY))
    rows = [
        f"""SELECT 'missing_values' AS "check", '*' AS "column", CAST(tm AS BIGINT) AS "count", round(tm * 100.0::DOUBLE / (n * {len(DIRTY)}), 2) AS percent,
          CASE WHEN tm * 100.0::DOUBLE / (n * {len(DIRTY)}) > 5 THEN 'failed' WHEN tm > 0 THEN 'warning' ELSE 'passed' END AS status FROM t""",
        "SELECT 'outliers', '*', CAST(tot AS BIGINT), round(tot * 100.0::DOUBLE / n, 2), CASE WHEN tot > 0 THEN 'warning' ELSE 'passed' END FROM t",
        "SELECT 'value_ranges', '*', CAST(tr AS BIGINT), round(tr * 100.0::DOUBLE / n, 2), CASE WHEN tr > 0 THEN 'failed' ELSE 'passed' END FROM t",
        """SELECT 'duplicates', '*', CAST(dup AS BIGINT), round(dup * 100.0::DOUBLE / n, 2),
          CASE WHEN dup * 100.0::DOUBLE / n > 1 THEN 'failed' WHEN dup > 0 THEN 'warning' ELSE 'passed' END FROM d""",
        "SELECT 'schema', '*', CAST(0 AS BIGINT), 0.0::DOUBLE, 'passed'",
    ]
    rows += [
        f"SELECT 'missing_values', '{c}', CAST(m_{c} AS BIGINT), round(m_{c} * 100.0::DOUBLE / n, 2), CASE WHEN m_{c} > 0 THEN 'has_missing' ELSE 'passed' END FROM t"
        for c in DIRTY
    ]
    rows += [
        f"SELECT 'outliers', '{c}', CAST(o_{c} AS BIGINT), round(o_{c} * 100.0::DOUBLE / n, 2), CASE WHEN o_{c} > 0 THEN 'has_outliers' ELSE 'passed' END FROM t"
        for c in NUMERIC
    ]
    rows += [
        f"SELECT 'value_ranges', '{c}', CAST(r_{c} AS BIGINT), round(r_{c} * 100.0::DOUBLE / n, 2), CASE WHEN r_{c} > 0 THEN 'out_of_range' ELSE 'passed' END FROM t"
        for c in ("l_discount", "l_quantity")
    ]
    return ctes + " " + " UNION ALL ".join(rows)


def _report(t):
    return validate.validate(
        t.lineitem_dirty,
        expected_columns=list(DIRTY),
        value_ranges={"l_discount": (0.0, 1.0), "l_quantity": (1.0, 50.0)},
    )


@query("validate_report", "A8 A9 A10 A11 A12", _report_sql(), ("lineitem_dirty",))
def validate_report(t):
    """Missing values, duplicates, fence outliers, value ranges and columns of the dirty line items."""
    return _report(t)


_ADVICE = """CASE WHEN "check" = 'missing_values' AND status = 'failed' THEN 'Missing values exceed threshold'
  WHEN "check" = 'missing_values' AND status = 'warning' THEN 'Handle missing values'
  WHEN "check" = 'duplicates' AND status = 'failed' THEN 'Remove duplicate rows'
  WHEN "check" = 'duplicates' AND status = 'warning' THEN 'Consider removing duplicate rows'
  WHEN "check" = 'outliers' AND status = 'warning' THEN 'Investigate outliers'
  WHEN "check" = 'value_ranges' AND status = 'failed' THEN 'Fix value range violations'
  WHEN "check" = 'dtypes' AND status = 'failed' THEN 'Fix data type mismatches' END"""


@query(
    "validate_rollup",
    "A13 A14",
    f"""SELECT count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed,
      count(*) FILTER (WHERE status = 'warning') AS warnings, count(*) AS total_checks, count(*) FILTER (WHERE status = 'failed') = 0 AS validation_passed,
      string_agg({_ADVICE}, '; ' ORDER BY {_ADVICE}) AS recommendations
    FROM ({_report_sql()} UNION ALL SELECT 'dtypes', '*', 1, 0.0, 'failed') WHERE "column" = '*'""",
    ("lineitem_dirty",),
)
def validate_rollup(t):
    """Verdict and advice over the report; a dtype rule on the order key is broken on purpose."""
    report = validate.validate(
        t.lineitem_dirty,
        expected_columns=list(DIRTY),
        expected_dtypes={"l_orderkey": "float", "l_quantity": "float"},
        value_ranges={"l_discount": (0.0, 1.0), "l_quantity": (1.0, 50.0)},
    )
    return validate.rollup(report)


@query(
    "profile_numeric",
    "A4",
    """WITH n AS (SELECT count(*) AS rows FROM lineitem_dirty), """
    + ", ".join(
        f"""p_{c} AS (SELECT '{c}' AS "column", count({c}) AS "count", avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std,
        min(CAST({c} AS DOUBLE)) AS "min", max(CAST({c} AS DOUBLE)) AS "max", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25,
        quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75,
        count(*) - count({c}) AS missing, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS missing_percent FROM lineitem_dirty)"""
        for c in NUMERIC
    )
    + " SELECT "
    + """"column", "count", round(mean, 4) AS mean, round(std, 4) AS std, "min", "max", round(q25, 4) AS q25, round(q50, 4) AS q50,
      round(q75, 4) AS q75, missing, round(missing_percent, 4) AS missing_percent FROM ("""
    + " UNION ALL ".join(f"SELECT * FROM p_{c}" for c in NUMERIC)
    + ")",
    ("lineitem_dirty",),
)
def profile_numeric(t):
    """Count, mean, sample deviation, range, quartiles and missing share per numeric column."""
    out = profile.profile_numeric(t.lineitem_dirty)
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75", "missing_percent")]
    return out.select("column", "count", "min", "max", "missing", *rounded)


CATS = ("p_name", "p_brand", "p_type")
_VALUES = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part GROUP BY {c}" for c in CATS)


@query(
    "profile_categorical",
    "A5",
    f"""WITH v AS ({_VALUES}), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk FROM v)
    SELECT "column", CAST(sum(n) AS BIGINT) AS "count", count(*) AS "unique", max(value) FILTER (WHERE rk = 1) AS top,
      max(n) FILTER (WHERE rk = 1) AS freq, CAST(0 AS BIGINT) AS missing, CAST(0 AS DOUBLE) AS missing_percent FROM r GROUP BY "column" """,
)
def profile_categorical(t):
    """Count, distinct, most frequent value and missing share per text column."""
    return profile.profile_categorical(t.part)


@query(
    "top_values",
    "A5 T5",
    f"""WITH v AS ({_VALUES}) SELECT * FROM (SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM v)
    WHERE rank <= 10""",
)
def top_values(t):
    """Ten most frequent values per text column."""
    return profile.top_values(t.part)


_CORR = ("l_quantity", "l_extendedprice", "net", "gross", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]


@query(
    "profile_corr",
    "A6",
    "WITH x AS (SELECT *, l_extendedprice * (1 - l_discount) AS net, CASE WHEN l_linenumber > 2 THEN l_quantity * -100 - l_extendedprice END AS gross FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 6) AS correlation FROM x) WHERE abs(correlation) > 0.5"
        for a, b in _PAIRS
    ),
)
def profile_corr(t):
    """Column pairs of the line items, derived prices included, with |r| above one half."""
    df = t.lineitem.select(
        "l_quantity",
        "l_extendedprice",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.when(F.col("l_linenumber") > 2, F.col("l_quantity") * -100 - F.col("l_extendedprice")).alias("gross"),
        "l_tax",
    )
    return profile.correlations(df).withColumn("correlation", F.round("correlation", 6))


@query(
    "quality_score",
    "A7",
    f"""WITH g AS (SELECT count(*) AS n, {", ".join(DIRTY)} FROM lineitem_dirty GROUP BY {", ".join(DIRTY)}),
    s AS (SELECT sum(n) AS rows, sum(n * ({" + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in DIRTY)})) AS miss, sum(n - 1) AS dup FROM g)
    SELECT CAST(rows AS BIGINT) AS total_rows, CAST(miss AS BIGINT) AS missing_values, CAST(dup AS BIGINT) AS duplicate_rows,
      CAST({len(DIRTY)} AS BIGINT) AS total_columns, CAST(6 AS BIGINT) AS numeric_columns, CAST(1 AS BIGINT) AS categorical_columns,
      CAST(1 AS BIGINT) AS datetime_columns,
      round(greatest(0, least(100, 100 - miss * 100.0::DOUBLE / (rows * {len(DIRTY)}) - dup * 10.0::DOUBLE / rows)), 6) AS quality_score FROM s""",
    ("lineitem_dirty",),
)
def quality_score(t):
    """Overview counts and the 0..100 quality score."""
    return profile.quality_score(t.lineitem_dirty).withColumn("quality_score", F.round("quality_score", 6))


@query(
    "geo_validate",
    "A17 F2",
    """WITH l AS (SELECT CASE WHEN id % 29 = 0 THEN latitude * 2 ELSE latitude END AS latitude,
        CASE WHEN id % 31 = 0 THEN longitude * 2 WHEN id % 37 = 0 THEN NULL ELSE longitude END AS longitude FROM locations),
      r AS (SELECT 0 AS position, 'latitude_range' AS rule, 'latitude' AS "column", 'ERROR' AS level, count(*) FILTER (WHERE latitude NOT BETWEEN -90 AND 90) AS "count" FROM l
        UNION ALL SELECT 1, 'longitude_range', 'longitude', 'ERROR', count(*) FILTER (WHERE longitude NOT BETWEEN -180 AND 180) FROM l)
    SELECT * FROM r WHERE "count" > 0""",
    ("locations",),
)
def geo_validate(t):
    """Coordinate range rules over shifted locations."""
    df = t.locations.select(
        F.expr("CASE WHEN id % 29 = 0 THEN latitude * 2 ELSE latitude END").alias("latitude"),
        F.expr("CASE WHEN id % 31 = 0 THEN longitude * 2 WHEN id % 37 = 0 THEN NULL ELSE longitude END").alias("longitude"),
    )
    return validate.Validation().coordinates().issues(df)


@query(
    "rule_check",
    "A15 A16 A18 F27 U1 U3 X2",
    """WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_nationkey IS NULL) AS m_n, count(*) FILTER (WHERE c_acctbal IS NULL) AS m_a,
        count(*) FILTER (WHERE c_mktsegment IS NULL) AS m_m, count(*) FILTER (WHERE c_acctbal < 0) AS neg,
        count(*) FILTER (WHERE NOT regexp_matches(c_mktsegment, '^[A-Z]{8,9}$')) AS odd,
        count(*) - count(DISTINCT c_custkey) AS dup FROM customer_dirty),
      r AS (SELECT 0 AS position, 'missing_column' AS rule, 'c_phone' AS "column", 'ERROR' AS level, CAST(1 AS BIGINT) AS "count"
        UNION ALL SELECT 1, 'dtype_mismatch', 'c_mktsegment', 'WARNING', 1
        UNION ALL SELECT 3, 'missing_values', 'c_nationkey', 'WARNING', CASE WHEN m_n * 100.0 / n > 10 THEN m_n ELSE 0 END FROM s
        UNION ALL SELECT 4, 'missing_values', 'c_acctbal', 'WARNING', CASE WHEN m_a * 100.0 / n > 10 THEN m_a ELSE 0 END FROM s
        UNION ALL SELECT 5, 'missing_values', 'c_mktsegment', 'WARNING', CASE WHEN m_m * 100.0 / n > 10 THEN m_m ELSE 0 END FROM s
        UNION ALL SELECT 7, 'negative_balance', 'c_acctbal', 'WARNING', neg FROM s
        UNION ALL SELECT 8, 'segment_format', 'c_mktsegment', 'ERROR', odd FROM s
        UNION ALL SELECT 9, 'unique', 'c_custkey', 'ERROR', dup FROM s
        UNION ALL SELECT 10, 'null_share', '*', 'INFO', n FROM s)
    SELECT * FROM r WHERE "count" > 0""",
    ("customer_dirty",),
)
def rule_check(t):
    """A chain of schema, quality, row and custom rules over dirty customers."""
    chain = (
        validate.Validation()
        .schema(["c_custkey", "c_phone"], {"c_mktsegment": "int"})
        .quality(10.0, unique=["c_custkey"])
        .rule("negative_balance", "c_acctbal", F.col("c_acctbal") < 0, "WARNING")
        .rule("segment_format", "c_mktsegment", ~F.col("c_mktsegment").rlike("^[A-Z]{8,9}$"))
        .custom(
            lambda df: df.agg(F.count(F.lit(1)).alias("count")).select(
                F.lit("null_share").alias("rule"), F.lit("*").alias("column"), F.lit("INFO").alias("level"), "count"
            )
        )
    )
    return chain.issues(t.customer_dirty)


@query(
    "suggest_features",
    "A19",
    """SELECT 'interaction_features' AS kind, 'c_custkey x c_nationkey' AS detail UNION ALL SELECT 'one_hot_encoding', 'c_mktsegment'
    UNION ALL SELECT 'impute', concat_ws(', ', CASE WHEN a > 0 THEN 'c_nationkey' END, CASE WHEN b > 0 THEN 'c_acctbal' END, CASE WHEN c > 0 THEN 'c_mktsegment' END)
      FROM (SELECT count(*) - count(c_nationkey) AS a, count(*) - count(c_acctbal) AS b, count(*) - count(c_mktsegment) AS c FROM customer_dirty)
    UNION ALL SELECT 'k_fold', 'small dataset' FROM (SELECT count(*) AS n FROM customer_dirty) WHERE n < 1000""",
    ("customer_dirty",),
)
def suggest_features(t):
    """Feature suggestions for predicting the account balance."""
    return profile.suggest_features(t.customer_dirty, "c_acctbal")


@query(
    "training_set_stats",
    "A29",
    """SELECT count(*) AS n_samples, CAST(3 AS BIGINT) AS n_features, count(DISTINCT c_mktsegment) AS n_classes,
      concat_ws(',', CASE WHEN count(*) - count(c_custkey) > 0.5 * count(*) THEN 'c_custkey' END,
        CASE WHEN count(*) - count(c_nationkey) > 0.5 * count(*) THEN 'c_nationkey' END,
        CASE WHEN count(*) - count(bal) > 0.5 * count(*) THEN 'bal' END) AS sparse_columns
    FROM (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS bal FROM customer_dirty)""",
    ("customer_dirty",),
)
def training_set_stats(t):
    """Sample, feature and class counts; columns more than half empty."""
    df = t.customer_dirty.select("c_custkey", "c_nationkey", "c_mktsegment", F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END").alias("bal"))
    from tidemark.operators.columns import missing

    sparse = [F.when(F.count_if(missing(df, c)) > F.count(F.lit(1)) * 0.5, F.lit(c)) for c in ("c_custkey", "c_nationkey", "bal")]
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.lit(3).cast("bigint").alias("n_features"),
        F.count_distinct("c_mktsegment").alias("n_classes"),
        F.concat_ws(",", *sparse).alias("sparse_columns"),
    )
