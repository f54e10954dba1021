"""Derived input tables, written in the SQL subset that Spark and DuckDB share.

Each entry is ``name: (text, inputs)``; the inputs appear in the text as ``{name}``.
"""

_DIRTY_COLUMNS = """l_orderkey, l_linenumber,
  CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN l_orderkey % 53 = 0 THEN CAST(-1.0 AS DOUBLE) ELSE l_discount END AS l_discount,
  l_tax, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_shipdate"""

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "locations": (
        """SELECT c_custkey AS id, c_name AS name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'city' WHEN 'BUILDING' THEN 'region' WHEN 'FURNITURE' THEN 'country'
                    WHEN 'HOUSEHOLD' THEN 'poi' ELSE 'custom' END AS location_type,
  c_nationkey AS country_key,
  CAST((c_custkey * 7919) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) AS latitude,
  CAST((c_custkey * 104729) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS longitude,
  c_acctbal AS population, c_custkey % 17 = 0 AS is_deleted
FROM {customer}""",
        ("customer",),
    ),
    "locations_dense": (
        """SELECT c_custkey AS id,
  CAST(10 AS DOUBLE) + CAST(((c_custkey % 60) * 37) % 61 AS DOUBLE) * CAST(0.5 AS DOUBLE)
    + CAST(CAST(floor((c_custkey - c_custkey % 60) / 60) AS BIGINT) % 20 AS DOUBLE)
      * CASE WHEN c_custkey % 5 = 0 THEN CAST(0.017 AS DOUBLE) ELSE CAST(0.004 AS DOUBLE) END AS latitude,
  CAST(72 AS DOUBLE) + CAST(((c_custkey % 60) * 53) % 59 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS longitude
FROM {customer}""",
        ("customer",),
    ),
    "lineitem_dirty": (
        f"""SELECT {_DIRTY_COLUMNS} FROM {{lineitem}}
UNION ALL
SELECT {_DIRTY_COLUMNS} FROM {{lineitem}} WHERE l_orderkey % 101 = 0""",
        ("lineitem",),
    ),
    "customer_dirty": (
        """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
  CASE WHEN c_custkey % 50 = 0 THEN c_acctbal * 40 WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM {customer}
UNION ALL
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END,
  CASE WHEN c_custkey % 50 = 0 THEN c_acctbal * 40 WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END
FROM {customer} WHERE c_custkey % 25 = 0""",
        ("customer",),
    ),
    "models": (
        """SELECT p_partkey AS id, p_brand AS name, p_type AS model_type, p_size AS version,
  CASE p_partkey % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'archived' ELSE 'training' END AS status,
  p_partkey * 3 % 1009 AS created_seq
FROM {part}""",
        ("part",),
    ),
    "predictions": (
        """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 50 AS model_id,
  CASE WHEN o_totalprice > 150000 THEN 'urban' ELSE 'rural' END AS predicted_value,
  CASE WHEN o_orderkey % 7 = 0 THEN 'rural' WHEN o_totalprice > 150000 THEN 'urban' ELSE 'rural' END AS actual_value,
  CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, o_orderdate AS created_at
FROM {orders}""",
        ("orders",),
    ),
    "agent_executions": (
        """SELECT event_id AS id, user_id,
  CASE user_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'ml' ELSE 'geo' END AS agent_type,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'pending' ELSE 'completed' END AS status,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS execution_time_ms,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id - event_id % 4 END AS parent_execution_id, ts AS created_at
FROM {events}""",
        ("events",),
    ),
    "light_curve": (
        "SELECT user_id AS object_id, ts AS obs_time, CAST(12 AS DOUBLE) + value / CAST(1000 AS DOUBLE) AS magnitude FROM {events}",
        ("events",),
    ),
    "stars": (
        """SELECT p_partkey AS star_id, CAST((p_partkey * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) AS ra_deg,
  CAST((p_partkey * 104729) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) AS dec_deg,
  CAST(p_size AS DOUBLE) / CAST(4 AS DOUBLE) AS magnitude,
  CAST(1 AS DOUBLE) + CAST(p_partkey % 300 AS DOUBLE) AS parallax_mas
FROM {part}""",
        ("part",),
    ),
    "graph_edges": (
        """SELECT vec_id AS source_id, (vec_id * 7 + 3) % 500 AS target_id, 'PRECEDES' AS edge_type FROM {embeddings}
UNION ALL SELECT vec_id, (vec_id * 11 + 5) % 500, 'CORRELATES_WITH' FROM {embeddings} WHERE vec_id % 3 = 0""",
        ("embeddings",),
    ),
    "ledger": (
        """SELECT id, agent_name, input_hash, output_hash,
  CASE WHEN id % 137 = 5 THEN md5('broken') ELSE lag(output_hash) OVER (PARTITION BY agent_name ORDER BY id) END AS prev_hash
FROM (SELECT event_id AS id, event_type AS agent_name, md5(CAST(user_id AS VARCHAR(20))) AS input_hash,
        md5(concat(CAST(event_id AS VARCHAR(20)), ':', event_type)) AS output_hash FROM {events}) base""",
        ("events",),
    ),
}
