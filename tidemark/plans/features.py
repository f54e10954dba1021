"""Cleaning, imputing, scaling, encoding and ordered-window queries."""

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import clean, stages, windows
from tidemark.plans.registry import query

NUM = ("l_quantity", "l_extendedprice", "l_discount")
_KEYS = "l_orderkey, l_linenumber, l_shipdate"


def _dirty(t):
    return t.lineitem_dirty.select("l_orderkey", "l_linenumber", "l_shipdate", *NUM)


def _scaled(t, strategy):
    out = stages.Scale(strategy, list(NUM)).fit_transform(_dirty(t))
    return out.withColumns({c: F.round(c, 6) for c in NUM})


def _scale_sql(center, spread):
    parts = ", ".join(f"round(({c} - {center.format(c=c)}) / {spread.format(c=c)}, 6) AS {c}" for c in NUM)
    stats = ", ".join(
        f"avg({c}) AS {c}_avg, stddev_pop({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max, "
        f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_q2, quantile_cont({c}, 0.75) AS {c}_q3"
        for c in NUM
    )
    return f"WITH s AS (SELECT {stats} FROM lineitem_dirty) SELECT {_KEYS}, {parts} FROM lineitem_dirty, s"


@query("scale_standard", "M1", _scale_sql("{c}_avg", "{c}_std"), ("lineitem_dirty",))
def scale_standard(t):
    """Zero mean, unit population deviation; nulls stay null."""
    return _scaled(t, "standard")


@query("scale_minmax", "M2", _scale_sql("{c}_min", "({c}_max - {c}_min)"), ("lineitem_dirty",))
def scale_minmax(t):
    """Scale to 0..1."""
    return _scaled(t, "minmax")


@query("scale_robust", "M3", _scale_sql("{c}_q2", "({c}_q3 - {c}_q1)"), ("lineitem_dirty",))
def scale_robust(t):
    """Median and quartile range scaling with exact quantiles."""
    return _scaled(t, "robust")


@query(
    "encode_label",
    "M4",
    """WITH d AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT coalesce(l_returnflag, 'nan') AS v FROM lineitem_dirty))
    SELECT l_orderkey, l_linenumber, d.i AS l_returnflag FROM lineitem_dirty JOIN d ON coalesce(l_returnflag, 'nan') = d.v""",
    ("lineitem_dirty",),
)
def encode_label(t):
    """Index of the return flag in sorted order, null as its own token."""
    df = t.lineitem_dirty.select("l_orderkey", "l_linenumber", "l_returnflag")
    return stages.LabelEncode(["l_returnflag"]).fit_transform(df)


@query(
    "encode_ordinal_unseen",
    "M5",
    """WITH d AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT c_name AS v FROM customer WHERE c_acctbal > 0))
    SELECT c_custkey, coalesce(d.i, -1) AS c_name FROM customer LEFT JOIN d ON c_name = d.v""",
)
def encode_ordinal_unseen(t):
    """A dictionary fitted on the solvent customers, replayed on all; unknown names get -1."""
    known = t.customer.filter("c_acctbal > 0")
    return stages.LabelEncode(["c_name"], unseen=-1).fit(known).transform(t.customer.select("c_custkey", "c_name"))


@query(
    "encode_onehot",
    "M6",
    """SELECT c_custkey, """
    + ", ".join(f"CAST(coalesce(c_mktsegment = '{s}', FALSE) AS INTEGER) AS c_mktsegment_{s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    + " FROM customer_dirty",
    ("customer_dirty",),
)
def encode_onehot(t):
    """One 0/1 column per market segment."""
    return stages.OneHot(["c_mktsegment"]).fit_transform(t.customer_dirty.select("c_custkey", "c_mktsegment"))


@query(
    "encode_target",
    "M7",
    """WITH tr AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), m AS (SELECT o_custkey, avg(floor(o_totalprice)) AS v FROM tr GROUP BY o_custkey)
    SELECT o.o_orderkey, round(coalesce(m.v, (SELECT avg(floor(o_totalprice)) FROM tr)), 7) AS o_custkey_target FROM orders o LEFT JOIN m ON o.o_custkey = m.o_custkey""",
)
def encode_target(t):
    """Mean order price per customer, fitted on the orders before 1998."""
    train = t.orders.filter("o_orderdate < TIMESTAMP_NTZ '1998-01-01'").select("o_custkey", F.floor("o_totalprice").cast("double").alias("price"))
    stage = stages.TargetEncode("o_custkey", "price").fit(train)
    out = stage.transform(t.orders.select("o_orderkey", "o_custkey"))
    return out.select("o_orderkey", F.round("o_custkey_target", 7).alias("o_custkey_target"))


def _impute_sql(expr):
    return f"SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT {expr} FROM lineitem_dirty)), 6) AS l_quantity FROM lineitem_dirty"


def _imputed(t, strategy, value=None):
    df = t.lineitem_dirty.select("l_orderkey", "l_linenumber", "l_quantity")
    return stages.Impute(strategy, fill_value=value).fit_transform(df).withColumn("l_quantity", F.round("l_quantity", 6))


@query("impute_mean", "M8 M9", _impute_sql("avg(l_quantity)"), ("lineitem_dirty",))
def impute_mean(t):
    """Gaps filled with the mean."""
    return _imputed(t, "mean")


@query("impute_median", "M8 M9", _impute_sql("quantile_cont(l_quantity, 0.5)"), ("lineitem_dirty",))
def impute_median(t):
    """Gaps filled with the exact median."""
    return _imputed(t, "median")


@query("impute_constant", "M8 M9", "SELECT l_orderkey, l_linenumber, coalesce(l_quantity, -7) AS l_quantity FROM lineitem_dirty", ("lineitem_dirty",))
def impute_constant(t):
    """Gaps filled with a constant."""
    return _imputed(t, "constant", -7.0)


@query(
    "impute_mode",
    "M8 M9",
    """WITH a AS (SELECT l_returnflag AS v FROM lineitem_dirty WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    b AS (SELECT l_quantity AS v FROM lineitem_dirty WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, (SELECT v FROM a)) AS l_returnflag, coalesce(l_quantity, (SELECT v FROM b)) AS l_quantity FROM lineitem_dirty""",
    ("lineitem_dirty",),
)
def impute_mode(t):
    """Gaps filled with the most frequent value, the smallest on ties."""
    df = t.lineitem_dirty.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return stages.Impute("mode").fit_transform(df)


_FILL_SQL = """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
  SELECT event_id, user_id, {fn}(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {frame}) AS v FROM e"""


def _gappy(t):
    return t.events.select("event_id", "user_id", "ts", F.expr("CASE WHEN event_id % 3 = 0 THEN value END").alias("v"))


@query("ffill", "W6", _FILL_SQL.format(fn="last_value", frame="UNBOUNDED PRECEDING AND CURRENT ROW"))
def ffill(t):
    """Last known value carried forward per user."""
    return windows.fill(_gappy(t), ["user_id"], ["ts", "event_id"], ["v"]).drop("ts")


@query("bfill", "W6", _FILL_SQL.format(fn="first_value", frame="CURRENT ROW AND UNBOUNDED FOLLOWING"))
def bfill(t):
    """Next known value carried backward per user."""
    return windows.fill(_gappy(t), ["user_id"], ["ts", "event_id"], ["v"], forward=False).drop("ts")


_CUST = ("c_custkey", "c_nationkey", "c_acctbal")
_CLEAN_CTES = """WITH d0 AS (SELECT DISTINCT * FROM customer_dirty),
  m AS (SELECT quantile_cont(CAST(c_nationkey AS DOUBLE), 0.5) AS mn, quantile_cont(c_acctbal, 0.5) AS ma FROM d0),
  ms AS (SELECT c_mktsegment AS v FROM d0 WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  d1 AS (SELECT c_custkey, coalesce(c_nationkey, mn) AS c_nationkey, coalesce(c_acctbal, ma) AS c_acctbal, coalesce(c_mktsegment, v) AS c_mktsegment FROM d0, m, ms)"""


def _chain(start: str, cols) -> str:
    parts, prev = [], start
    for i, c in enumerate(cols):
        parts.append(
            f"f{i} AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {prev}), "
            f"o{i} AS (SELECT {prev}.* FROM {prev}, f{i} WHERE {c} IS NULL OR NOT ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))"
        )
        prev = f"o{i}"
    return ", ".join(parts)


@query(
    "clean_ops",
    "M11 M12 M13 M20 W9",
    f"{_CLEAN_CTES}, {_chain('d1', _CUST)} SELECT c_custkey, CAST(c_nationkey AS INTEGER) AS c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM o2",
    ("customer_dirty",),
)
def clean_ops(t):
    """De-duplicate, fill gaps, then drop outliers column by column."""
    out = clean.clean(t.customer_dirty, ["remove_duplicates", "fill_missing", "remove_outliers"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 4))


@query(
    "outliers_sequential",
    "M13",
    f"WITH {_chain('lineitem_dirty', ('l_orderkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))} SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM o5",
    ("lineitem_dirty",),
)
def outliers_sequential(t):
    """Line items left after fences recomputed on the survivors of each column."""
    return clean.remove_outliers(t.lineitem_dirty).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


@query(
    "outliers_zscore",
    "M14",
    """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d FROM lineitem_dirty)
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem_dirty, s WHERE abs((l_extendedprice - m) / d) <= 3""",
    ("lineitem_dirty",),
)
def outliers_zscore(t):
    """Line items within three deviations of the mean price."""
    df = t.lineitem_dirty.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.remove_zscore_outliers(df, 3.0, ["l_extendedprice"])


@query(
    "clean_score",
    "A32 S14",
    f"""{_CLEAN_CTES}, b AS (SELECT count(*) AS n, count(*) * 4 - count(c_custkey) - count(c_nationkey) - count(c_acctbal) - count(c_mktsegment) AS m FROM customer_dirty),
    a AS (SELECT count(*) AS n FROM d1)
    SELECT b.n AS before_rows, b.m AS before_missing, round(100 - b.m * 100.0::DOUBLE / (b.n * 4), 2) AS before_score, a.n AS after_rows,
      CAST(0 AS BIGINT) AS after_missing, CAST(100 AS DOUBLE) AS after_score, round(100 - round(100 - b.m * 100.0::DOUBLE / (b.n * 4), 2), 2) AS improvement_percent FROM a, b""",
    ("customer_dirty",),
)
def clean_score(t):
    """Rows, gaps and score before and after cleaning."""
    df = t.customer_dirty
    return clean.before_after(df, clean.clean(df, ["remove_duplicates", "fill_missing"]))


@query(
    "create_features",
    "F11 M15 X1 X3",
    """SELECT o_orderkey, round(o_custkey * o_totalprice, 2) AS o_custkey_o_totalprice_interaction, round(o_custkey / (o_totalprice + 1e-10), 8) AS o_custkey_o_totalprice_ratio,
      o_totalprice > 150000 AS is_large, length(o_orderpriority) AS priority_length FROM orders""",
)
def create_features(t):
    """Product and ratio features, then user functions; one of them fails and is skipped."""
    df = clean.transform(t.orders.select("o_custkey", "o_totalprice", "o_orderkey", "o_orderpriority"), ["create_features"])
    made = stages.Features(
        {
            "is_large": F.col("o_totalprice") > 150000,
            "broken": lambda d: F.col("no_such_column") + 1,
            "priority_length": lambda d: F.length(d["o_orderpriority"]).cast("bigint"),
        }
    ).fit_transform(df)
    return made.select(
        "o_orderkey",
        F.round("o_custkey_o_totalprice_interaction", 2).alias("o_custkey_o_totalprice_interaction"),
        F.round("o_custkey_o_totalprice_ratio", 8).alias("o_custkey_o_totalprice_ratio"),
        "is_large",
        "priority_length",
    )


@query(
    "datetime_parts",
    "F10",
    """SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
      CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek FROM orders""",
)
def datetime_parts(t):
    """Year, month, day and Monday-based weekday of the order date."""
    return clean.transform(t.orders.select("o_orderkey", "o_orderdate"), ["datetime_features"])


@query(
    "transform_ops",
    "M20 M4 M1",
    """WITH s AS (SELECT avg(c_custkey) AS mk, stddev_pop(c_custkey) AS sk, avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa FROM customer),
    d AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT c_mktsegment AS v FROM customer))
    SELECT c_custkey, c_acctbal, c_mktsegment, round((c_custkey - mk) / sk, 6) AS c_custkey_normalized, round((c_acctbal - ma) / sa, 6) AS c_acctbal_normalized,
      d.i AS c_mktsegment_encoded FROM customer, s JOIN d ON c_mktsegment = d.v""",
)
def transform_ops(t):
    """Ordered transform list: normalise then encode, as new columns."""
    out = clean.transform(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), ["normalize", "encode_categorical"])
    return out.withColumns({f"{c}_normalized": F.round(f"{c}_normalized", 6) for c in ("c_custkey", "c_acctbal")})


@query(
    "preprocess_replay",
    "M16 M17",
    """WITH tr AS (SELECT * FROM customer_dirty WHERE c_nationkey IS NULL OR c_nationkey < 18),
    md AS (SELECT quantile_cont(CAST(c_nationkey AS DOUBLE), 0.5) AS mn, quantile_cont(c_acctbal, 0.5) AS ma FROM tr),
    fl AS (SELECT coalesce(c_nationkey, mn) AS n, coalesce(c_acctbal, ma) AS a FROM tr, md),
    s AS (SELECT avg(n) AS an, stddev_pop(n) AS sn, avg(a) AS aa, stddev_pop(a) AS sa FROM fl),
    d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT coalesce(c_mktsegment, 'nan') AS v FROM tr WHERE c_mktsegment IS NULL OR c_mktsegment <> 'BUILDING'))
    SELECT c_custkey, round((coalesce(c_nationkey, mn) - an) / sn, 6) AS f0, round((coalesce(c_acctbal, ma) - aa) / sa, 6) AS f1,
      CAST(coalesce(d.i, -1) AS DOUBLE) AS f2 FROM customer_dirty, md, s LEFT JOIN d ON coalesce(c_mktsegment, 'nan') = d.v""",
    ("customer_dirty",),
)
def preprocess_replay(t):
    """Preprocessor fitted on a train part and replayed on all rows; an unseen segment becomes -1."""
    df = t.customer_dirty.select("c_nationkey", "c_acctbal", "c_mktsegment", "c_custkey")
    train = df.filter("c_nationkey IS NULL OR c_nationkey < 18")
    prep = stages.Preprocess()
    known = train.filter("c_mktsegment IS NULL OR c_mktsegment <> 'BUILDING'").drop("c_custkey")
    prep.fit(train.drop("c_custkey"))
    prep.labels = stages.LabelEncode(["c_mktsegment"], unseen=-1).fit(known)
    out = prep.transform(df)
    return out.select("c_custkey", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(3)])


@query(
    "polynomial",
    "M18",
    """SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity, 4) AS "l_quantity^2", round(l_quantity * l_tax, 6) AS "l_quantity*l_tax", round(l_tax * l_tax, 6) AS "l_tax^2" FROM lineitem""",
)
def polynomial(t):
    """Degree-two terms of two columns."""
    out = stages.Polynomial(["l_quantity", "l_tax"]).transform(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"))
    return out.select(
        "l_orderkey",
        "l_linenumber",
        F.round("`l_quantity^2`", 4).alias("l_quantity^2"),
        F.round("`l_quantity*l_tax`", 6).alias("l_quantity*l_tax"),
        F.round("`l_tax^2`", 6).alias("l_tax^2"),
    )


_SEL = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "select_k_best",
    "M19",
    """WITH a AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, l_linenumber % 4 AS y, {c} * (1 + (l_linenumber % 4) / 10.0::DOUBLE) AS x FROM lineitem" for c in _SEL)
    + """), g AS (SELECT feature, y, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM a GROUP BY feature, y),
    t AS (SELECT feature, avg(x) AS mm FROM a GROUP BY feature),
    f AS (SELECT feature, (sum(n * (m - mm) * (m - mm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score FROM g JOIN t USING (feature) GROUP BY feature)
    SELECT feature, round(f_score, 3) AS f_score FROM f ORDER BY f_score DESC LIMIT 3""",
)
def select_k_best(t):
    """The three features with the best F statistic against a class label."""
    y = F.col("l_linenumber") % 4
    df = t.lineitem.select(y.alias("y"), *[(F.col(c) * (1 + y / 10)).alias(c) for c in _SEL])
    scores = stages.anova_f(df, list(_SEL), "y")
    best = stages.select_k_best(scores, "f_score", 3)
    return scores.filter(F.col("feature").isin(best)).withColumn("f_score", F.round("f_score", 3))


@query(
    "mutual_information",
    "M19",
    """WITH a AS (SELECT o_orderstatus AS y, 'price' AS feature, CAST(floor(o_totalprice / 50000) AS VARCHAR) AS bin FROM orders
      UNION ALL SELECT o_orderstatus, 'priority', o_orderpriority FROM orders),
    j AS (SELECT feature, bin, y, count(*) AS nxy FROM a GROUP BY ALL), x AS (SELECT feature, bin, sum(nxy) AS nx FROM j GROUP BY ALL),
    l AS (SELECT feature, y, sum(nxy) AS ny FROM j GROUP BY ALL), n AS (SELECT feature, sum(nxy) AS n FROM j GROUP BY ALL)
    SELECT feature, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 8) AS mutual_information FROM j JOIN x USING (feature, bin) JOIN l USING (feature, y) JOIN n USING (feature) GROUP BY feature""",
)
def mutual_information(t):
    """Mutual information of binned order features with the order status."""
    bins = {"price": F.floor(F.col("o_totalprice") / 50000), "priority": F.col("o_orderpriority")}
    out = stages.mutual_information(t.orders, bins, "o_orderstatus")
    return out.withColumn("mutual_information", F.round("mutual_information", 8))


@query(
    "rolling_7_14_30",
    "W4",
    "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(value) AS n, sum(round(value * 100)) AS s, min(round(value * 100)) AS lo, max(round(value * 100)) AS hi FROM events GROUP BY 1, 2) SELECT user_id, day"
    + "".join(
        f", CAST(sum(n) OVER w{d} AS BIGINT) AS count_{d}d, sum(s) OVER w{d} AS sum_{d}d, sum(s) OVER w{d} / sum(n) OVER w{d} AS mean_{d}d, min(lo) OVER w{d} AS min_{d}d, max(hi) OVER w{d} AS max_{d}d"
        for d in (7, 14, 30)
    )
    + " FROM d WINDOW "
    + ", ".join(f"w{d} AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL {d - 1} DAY PRECEDING AND CURRENT ROW)" for d in (7, 14, 30)),
)
def rolling_7_14_30(t):
    """Trailing 7, 14 and 30 day aggregates per user, in cents."""
    cents = t.events.select("user_id", "ts", F.round(F.col("value") * 100).alias("cents"))
    return windows.rolling_activity(cents, ["user_id"], "ts", "cents")


@query(
    "months_ago",
    "W8",
    """WITH m AS (SELECT o_orderpriority AS region, year(o_orderdate) * 12 + month(o_orderdate) AS mi, avg(o_totalprice) AS cur FROM orders GROUP BY 1, 2)
    SELECT a.region, CAST(a.mi AS INTEGER) AS month_index, round(a.cur, 4) AS "current", round(b.cur, 4) AS earlier, round(a.cur - b.cur, 4) AS delta
    FROM m a LEFT JOIN m b ON a.region = b.region AND b.mi = a.mi - 3""",
)
def months_ago(t):
    """Monthly mean against the mean three months before."""
    df = t.orders.select(F.col("o_orderpriority").alias("region"), "o_orderdate", "o_totalprice")
    out = windows.months_ago(df, ["region"], "o_orderdate", "o_totalprice", 3)
    return out.select("region", "month_index", *[F.round(c, 4).alias(c) for c in ("current", "earlier", "delta")])


@query(
    "labels_land_change",
    "F12",
    """WITH f AS (SELECT o_orderkey, (o_orderkey % 71) / 100.0::DOUBLE + 0.1 AS now, (o_orderkey % 67) / 100.0::DOUBLE + 0.1 AS before, (o_orderkey % 91) - 60.0::DOUBLE AS rain FROM orders)
    SELECT o_orderkey, CASE WHEN before - now > 0.15 AND rain < -20 THEN 3 WHEN before - now > 0.25 THEN 1 WHEN before - now > 0.10 THEN 2 ELSE 0 END AS label FROM f""",
)
def labels_land_change(t):
    """Land-change class by the first matching rule."""
    k = F.col("o_orderkey")
    df = t.orders.select(
        "o_orderkey",
        ((k % 71) / F.lit(100.0) + 0.1).alias("ndvi_current"),
        ((k % 67) / F.lit(100.0) + 0.1).alias("ndvi_3months_ago"),
        ((k % 91) - F.lit(60.0)).alias("rainfall_anomaly_pct"),
    )
    return df.select("o_orderkey", labels.land_change().alias("label"))


@query(
    "labels_drought",
    "F13",
    """SELECT o_orderkey, round(greatest(0, least(5, 3.0 * (0.20 - ((o_orderkey % 31) / 100.0::DOUBLE + 0.04)) / 0.16 + 2.0 * (-((o_orderkey % 111) - 70.0::DOUBLE) / 70)
      + 0.5 * ((o_orderkey % 8) - 2.0::DOUBLE) / 5)), 6) AS severity FROM orders""",
)
def labels_drought(t):
    """Drought severity target, held to 0..5."""
    k = F.col("o_orderkey")
    df = t.orders.select(
        "o_orderkey",
        ((k % 31) / F.lit(100.0) + 0.04).alias("soil_moisture"),
        ((k % 111) - F.lit(70.0)).alias("rainfall_anomaly_pct"),
        ((k % 8) - F.lit(2.0)).alias("temperature_anomaly"),
    )
    return df.select("o_orderkey", F.round(labels.drought_severity(), 6).alias("severity"))


@query(
    "synth_asteroid",
    "S16 F14",
    """WITH u AS (SELECT p_partkey AS id, """
    + ", ".join(f"CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || ':42:{n}'), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE AS u{i}" for i, n in enumerate(labels.ASTEROID_RANGES))
    + ", CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || ':42:label'), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE AS ul FROM part), f AS (SELECT id, ul, "
    + ", ".join(f"{lo} + u{i} * ({hi} - {lo}) AS {n}" for i, (n, (lo, hi)) in enumerate(labels.ASTEROID_RANGES.items()))
    + """ FROM u), p AS (SELECT *, greatest(0, least(1, 0.3 * (22 - magnitude) / 8 + 0.2 * (0.5 - distance_au) / 0.49 + 0.25 * (1 - cloud_cover_percent / 100)
      + 0.15 * object_altitude_deg / 85 + 0.1 * (1 - moon_phase))) AS prob FROM f)
    SELECT id, round(magnitude, 6) AS magnitude, round(distance_au, 6) AS distance_au, round(cloud_cover_percent, 6) AS cloud_cover_percent,
      round(prob, 6) AS probability, CAST(ul < prob AS INTEGER) AS label FROM p""",
)
def synth_asteroid(t):
    """Observation training rows: hashed uniform features and labels drawn from the probability rule."""
    from tidemark.sources import synth

    df = synth.asteroid_rows(t.part.select(F.col("p_partkey").alias("id")), seed=42)
    rounded = [F.round(c, 6).alias(c) for c in ("magnitude", "distance_au", "cloud_cover_percent", "probability")]
    return df.select("id", *rounded, "label")
