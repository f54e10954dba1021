"""Run registered queries in Spark and their SQL in DuckDB and compare the row multisets.

Usage: python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    return value


def type_family(name: str) -> str:
    name = name.lower()
    if "[]" in name or "array" in name:
        return "array"
    for family, keys in {
        "int": ("bigint", "integer", "int", "smallint", "hugeint", "long", "tinyint"),
        "float": ("double", "float", "real"),
        "decimal": ("decimal",),
        "str": ("varchar", "string"),
        "bool": ("bool",),
        "time": ("timestamp",),
        "date": ("date",),
    }.items():
        if any(name.startswith(k) for k in keys):
            return family
    return name


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short account of the difference."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(canonical(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    spark_sec = time.time() - t0
    n = sum(got.values())
    if sql is None:
        return ("rows-only", n, spark_sec, "")
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    duck_sec = time.time() - t0
    if sorted(names) != cols:
        return ("FAIL", n, spark_sec, f"columns {cols} vs {sorted(names)}")
    spark_types = {f.name: type_family(f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {d[0]: type_family(str(d[1])) for d in cur.description}
    odd = {c: (spark_types[c], duck_types[c]) for c in cols if spark_types[c] != duck_types[c]}
    order = [names.index(c) for c in cols]
    want = Counter(tuple(canonical(r[i]) for i in order) for r in rows)
    if got != want:
        left, right = list((got - want).items())[:3], list((want - got).items())[:3]
        return ("FAIL", n, spark_sec, f"rows {n} vs {sum(want.values())}\n   cols {cols}\n   spark only {left}\n   sql only   {right}")
    return ("ok" if not odd else "TYPE", n, spark_sec, f"{odd or ''} sql {duck_sec:.1f}s")


def main(argv):
    sf = f"{'/root/testdata'}/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    import __spark_entry__ as entry
    from tidemark.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name in [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]:
        try:
            status, n, sec, note = compare(spark, con, queries[name], sqls.get(name), sf)
        except Exception as e:  # report and go on
            status, n, sec, note = "ERROR", -1, 0.0, str(e)[:1500]
        if status not in ("ok", "rows-only"):
            bad.append(name)
        print(f"{status:9} {name:28} rows={n:<7} {sec:6.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
