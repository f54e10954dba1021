"""Astronomy, text routing, ledger and rate-limit queries."""

from pyspark.sql import functions as F

from tidemark.functions import astro, hashing, text
from tidemark.operators import ledger, limiter, spatial
from tidemark.plans.registry import query


@query(
    "astro_scalars",
    "F3 F4 F5 F6",
    """WITH s AS (SELECT *, 1000.0 / parallax_mas AS pc FROM stars)
    SELECT star_id, round(magnitude / 3.26156, 4) AS distance_parsecs, round(magnitude * 9.461e12 / 1e9, 3) AS distance_gm, round(magnitude * 63241.1, 4) AS distance_au,
      round(magnitude - 5 * (log10(pc) - 1), 2) AS absolute_magnitude, round(pow(10, (4.83 - (magnitude - 5 * (log10(pc) - 1))) / 2.5), 5) AS luminosity_ratio,
      round(pc, 2) AS parallax_parsecs, round(pc * 3.26156, 2) AS parallax_ly FROM s""",
    ("stars",),
)
def astro_scalars(t):
    """Distance units, absolute magnitude, luminosity and parallax distance of every star."""
    pc = F.try_divide(F.lit(1000.0), F.col("parallax_mas"))
    far = astro.distance_units(F.col("magnitude"))
    m = astro.absolute_magnitude(F.col("magnitude"), pc)
    par = astro.parallax(F.col("parallax_mas"))
    return t.stars.select(
        "star_id",
        far["distance_parsecs"].alias("distance_parsecs"),
        F.round(far["distance_km"] / 1e9, 3).alias("distance_gm"),
        F.round(far["distance_au"], 4).alias("distance_au"),
        F.round(m, 2).alias("absolute_magnitude"),
        F.round(astro.luminosity_ratio(m), 5).alias("luminosity_ratio"),
        par["distance_parsecs"].alias("parallax_parsecs"),
        par["distance_light_years"].alias("parallax_ly"),
    )


@query(
    "orbits",
    "F7",
    """WITH o AS (SELECT star_id, magnitude + 0.4 AS a, (star_id % 13) / 10.0::DOUBLE AS e, CAST(star_id * 3 AS DOUBLE) AS t FROM stars),
    k AS (SELECT *, pow(a, 1.5) AS y FROM o)
    SELECT star_id, round(a * (1 - e), 4) AS perihelion_au, round(a * (1 + e), 4) AS aphelion_au, round(y * 365.25, 2) AS period_days, round(y, 2) AS period_years,
      round(t / (y * 365.25) * 360 - 360 * floor(t / (y * 365.25)), 2) AS mean_anomaly_degrees, round(a * (1 - e) + 0.5 * (a * (1 + e) - a * (1 - e)), 3) AS mean_distance_au,
      round(29.78 * sqrt(2 / a - 1 / a), 6) AS circular_velocity_km_s, e < 1 AS is_closed_orbit, CASE WHEN e < 1 THEN 'elliptical' ELSE 'hyperbolic' END AS orbit_shape,
      CASE WHEN e < 1 THEN 'negative' ELSE 'positive' END AS energy FROM k""",
    ("stars",),
)
def orbits(t):
    """Kepler quantities of derived orbits, some of them open."""
    o = astro.orbit(F.col("magnitude") + 0.4, (F.col("star_id") % 13) / F.lit(10.0), (F.col("star_id") * 3).cast("double"))
    o["circular_velocity_km_s"] = F.round(o["circular_velocity_km_s"], 6)
    return t.stars.select("star_id", *[c.alias(n) for n, c in o.items()])


_SEP = "degrees(2 * asin(sqrt(least(1.0, pow(sin((radians({d2}) - radians({d1})) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * pow(sin((radians({r2}) - radians({r1})) / 2), 2)))))"


@query(
    "angular_separation",
    "F8",
    f"""SELECT star_id, round(d, 6) AS degrees, round(d * 60, 4) AS arcminutes, round(d * 3600, 2) AS arcseconds
    FROM (SELECT star_id, {_SEP.format(r1='ra_deg', d1='dec_deg', r2='88.7929', d2='7.4070')} AS d FROM stars)""",
    ("stars",),
)
def angular_separation(t):
    """Angle of every star to one bright star."""
    d = astro.separation_degrees(F.col("ra_deg"), F.col("dec_deg"), F.lit(88.7929), F.lit(7.4070))
    return t.stars.select("star_id", F.round(d, 6).alias("degrees"), F.round(d * 60, 4).alias("arcminutes"), F.round(d * 3600, 2).alias("arcseconds"))


_M = astro.GALACTIC


@query(
    "galactic_frame",
    "F9",
    f"""WITH v AS (SELECT star_id, cos(radians(dec_deg)) * cos(radians(ra_deg)) AS x, cos(radians(dec_deg)) * sin(radians(ra_deg)) AS y, sin(radians(dec_deg)) AS z FROM stars),
    g AS (SELECT star_id, {_M[0][0]} * x + {_M[0][1]} * y + {_M[0][2]} * z AS gx, {_M[1][0]} * x + {_M[1][1]} * y + {_M[1][2]} * z AS gy,
      {_M[2][0]} * x + {_M[2][1]} * y + {_M[2][2]} * z AS gz FROM v)
    SELECT star_id, round(CASE WHEN atan2(gy, gx) < 0 THEN degrees(atan2(gy, gx)) + 360 ELSE degrees(atan2(gy, gx)) END, 6) AS l, round(degrees(asin(gz)), 6) AS b,
      'no transform from icrs to fk4' AS fk4_reason FROM g""",
    ("stars",),
)
def galactic_frame(t):
    """Galactic coordinates of every star; an unsupported frame gives its reason."""
    g = astro.rotate(F.col("ra_deg"), F.col("dec_deg"), "icrs", "galactic")
    other = astro.rotate(F.col("ra_deg"), F.col("dec_deg"), "icrs", "fk4")
    return t.stars.select("star_id", F.round(g["lon"], 6).alias("l"), F.round(g["lat"], 6).alias("b"), other["reason"].alias("fk4_reason"))


@query(
    "cone_search",
    "J13",
    f"""SELECT star_id, round(s, 6) AS separation_deg FROM (SELECT star_id, {_SEP.format(r1='ra_deg', d1='dec_deg', r2='10.0', d2='-35.0')} AS s FROM stars)
    WHERE s <= 20 ORDER BY s, star_id LIMIT 25""",
    ("stars",),
)
def cone_search(t):
    """Nearest stars within 20 degrees of a centre."""
    return astro.cone_search(t.stars, 10.0, -35.0, 20.0, 25).select("star_id", F.round("separation_deg", 6).alias("separation_deg"))


@query(
    "cross_match",
    "J13",
    f"""WITH q AS (SELECT o_orderkey AS qid, CAST((o_orderkey * 3571) % 36000 AS DOUBLE) / 100 AS ra, CAST((o_orderkey * 7907) % 18000 AS DOUBLE) / 100 - 90 AS de FROM orders),
    d AS (SELECT qid, star_id, {_SEP.format(r1='ra_deg', d1='dec_deg', r2='ra', d2='de')} AS s FROM q JOIN stars ON dec_deg BETWEEN de - 1.01 AND de + 1.01),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 7), star_id) AS rn FROM d WHERE s <= 1)
    SELECT qid AS query_id, star_id, round(s, 5) AS separation_deg FROM r WHERE rn = 1""",
    ("stars",),
)
def cross_match(t):
    """Nearest star within one degree of every observation of a table."""
    k = F.col("o_orderkey")
    obs = t.orders.select(
        k.alias("query_id"), (((k * 7907) % 18000).cast("double") / 100 - 90).alias("latitude"), (((k * 3571) % 36000).cast("double") / 100).alias("longitude")
    )
    stars = t.stars.select(F.col("star_id").alias("id"), F.col("dec_deg").alias("latitude"), F.col("ra_deg").alias("longitude"))
    per_degree = 6371.0088 * 3.141592653589793 / 180
    out = spatial.nearest(obs, stars, radius_km=per_degree)
    return out.select("query_id", F.col("id").alias("star_id"), F.round(F.col("distance_km") / per_degree, 5).alias("separation_deg"))


@query(
    "light_curve_variability",
    "A25",
    """WITH a AS (SELECT object_id, avg(magnitude) AS m, stddev_pop(magnitude) AS s, min(magnitude) AS lo, max(magnitude) AS hi FROM light_curve GROUP BY object_id)
    SELECT object_id, round(m, 3) AS mean_magnitude, round(s, 3) AS std_deviation, lo AS min_magnitude, hi AS max_magnitude, round(hi - lo, 3) AS amplitude,
      round(s / m * 100, 2) AS variability_index, s > 0.05 AS is_variable,
      CASE WHEN s > 0.2 THEN 'highly_variable' WHEN s > 0.05 THEN 'moderately_variable' ELSE 'stable' END AS variability_class FROM a""",
    ("light_curve",),
)
def light_curve_variability(t):
    """Variability statistics and class per object."""
    return astro.variability(t.light_curve)


PERIODS = [0.5, 1.0, 2.0, 3.5, 5.37, 7.0, 10.74]


@query(
    "period_grid",
    "A26",
    f"""WITH x AS (SELECT object_id, magnitude AS m, p, 6.283185307179586 * (epoch_us(obs_time) / 86400000000.0::DOUBLE - 19700) / p AS a
      FROM light_curve, (SELECT unnest({PERIODS}::DOUBLE[]) AS p)),
    g AS (SELECT object_id, p, count(*) AS n, avg(m) AS mu, sum(cos(a)) AS c, sum(sin(a)) AS s, sum(m * cos(a)) AS mc, sum(m * sin(a)) AS ms FROM x GROUP BY object_id, p),
    w AS (SELECT object_id, p, 2 * sqrt(pow(mc - mu * c, 2) + pow(ms - mu * s, 2)) / n AS amp FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY amp DESC, p) AS rn FROM w)
    SELECT object_id, p AS period_days, round(amp, 6) AS amplitude FROM r WHERE rn = 1""",
    ("light_curve",),
)
def period_grid(t):
    """Strongest trial period of every object."""
    days = F.unix_micros(F.col("obs_time").cast("timestamp")) / F.lit(86400000000.0) - 19700
    return astro.best_period(astro.periods(t.light_curve, PERIODS, days)).withColumn("amplitude", F.round("amplitude", 6))


def _like(words):
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


_DOMAIN = "CASE " + " ".join(f"WHEN {_like(w)} THEN '{d}'" for d, w in text.DOMAIN_KEYWORDS.items()) + " ELSE 'multi' END"


def _case(key, table):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(
    "route_domain",
    "F15 F25",
    f"""WITH d AS (SELECT doc_id, {_DOMAIN} AS domain FROM documents)
    SELECT doc_id, domain, {_case('domain', text.DOMAIN_TABLE)} AS vector_table, {_case('domain', text.DOMAIN_AGENT)} AS agent,
      {_case('domain', {k: '|'.join(v) for k, v in text.DOMAIN_SOURCES.items()})} AS sources FROM d""",
)
def route_domain(t):
    """Domain, vector table, agent and data sources of every document text."""
    d = F.col("domain")
    return t.documents.select("doc_id", text.domain(F.col("text")).alias("domain")).select(
        "doc_id",
        "domain",
        text.lookup(d, text.DOMAIN_TABLE).alias("vector_table"),
        text.lookup(d, text.DOMAIN_AGENT).alias("agent"),
        F.array_join(text.sources(d), "|").alias("sources"),
    )


_AGENT_FLAGS = ", ".join(f"({_like(w)}) AS {a}" for a, w in text.AGENT_KEYWORDS.items())


@query(
    "select_agents",
    "F16 F17 F18 T6 F26",
    f"""WITH f AS (SELECT conv_id, turn, text, {_AGENT_FLAGS} FROM conversations),
    g AS (SELECT *, CASE WHEN NOT (data OR ml OR geo) THEN 'data' ELSE concat_ws(',', CASE WHEN data THEN 'data' END, CASE WHEN ml THEN 'ml' END, CASE WHEN geo THEN 'geo' END) END AS agents FROM f)
    SELECT conv_id, turn, agents, CASE WHEN len(string_split(agents, ',')) = 1 THEN 'simple' ELSE 'moderate' END AS complexity,
      CASE WHEN agents LIKE 'data%' THEN 'data:3' WHEN agents LIKE 'ml%' THEN 'ml:2' ELSE 'geo:2' END AS first_subtask,
      upper(substring(CASE WHEN agents LIKE 'data%' THEN 'Handle all data operations for: ' WHEN agents LIKE 'ml%' THEN 'Handle all ML operations for: '
        ELSE 'Handle all geospatial operations for: ' END || text, 1, 31)) AS first_task FROM g""",
)
def select_agents(t):
    """Agents, complexity and first subtask of every conversation turn."""
    df = t.conversations.withColumn("a", text.agents(F.col("text")))
    df = df.withColumn("s", text.subtasks(F.col("text"), F.col("a")))
    first = F.get("s", F.lit(0))
    return df.select(
        "conv_id",
        "turn",
        F.array_join("a", ",").alias("agents"),
        text.complexity(F.col("a")).alias("complexity"),
        F.concat(first["agent"], F.lit(":"), first["priority"].cast("string")).alias("first_subtask"),
        F.upper(F.substring(first["task"], 1, 31)).alias("first_task"),
    )


_ATTR = """SELECT event_id, unnest(['cloud_cover', 'k_value', 'moon_phase', 'user_load']) AS name,
  unnest([(event_id % 17 - 8) / 10.0::DOUBLE, (event_id % 23 - 11) / 7.0::DOUBLE, (event_id % 5 - 2) / 3.0::DOUBLE, value / 100]) AS v FROM events"""


def _attributions(t):
    k = F.col("event_id")
    values = F.create_map(
        F.lit("cloud_cover"), (k % 17 - 8) / F.lit(10.0), F.lit("k_value"), (k % 23 - 11) / F.lit(7.0),
        F.lit("moon_phase"), (k % 5 - 2) / F.lit(3.0), F.lit("user_load"), F.col("value") / 100,
    )
    return t.events.select("event_id", "event_type", "value", text.top_attributions(values, 3).alias("top"))


@query(
    "top_attributions",
    "W2 F20",
    f"""WITH a AS ({_ATTR}), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(v) DESC, name) AS rn FROM a)
    SELECT event_id, string_agg(name, ',' ORDER BY rn) AS names,
      string_agg(CASE WHEN rn <= 2 THEN replace(name, '_', ' ') || CASE WHEN v > 0 THEN ' increased' ELSE ' decreased' END || ' the prediction' END, '. ' ORDER BY rn) || '.' AS sentence
    FROM r WHERE rn <= 3 GROUP BY event_id""",
)
def top_attributions(t):
    """Three strongest attributions of every event and their sentence."""
    top = F.col("top")
    return _attributions(t).select(
        "event_id", F.array_join(F.transform(top, lambda e: e["name"]), ",").alias("names"), text.attribution_sentence(top).alias("sentence")
    )


@query(
    "answer_text",
    "F19",
    f"""WITH a AS ({_ATTR}), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(v) DESC, name) AS rn FROM a),
    k AS (SELECT event_id, ' Key factors: ' || string_agg(replace(name, '_', ' ') || CASE WHEN v > 0 THEN ' (positive impact)' ELSE ' (negative impact)' END, ', ' ORDER BY rn) || '.' AS kf
      FROM r WHERE rn <= 3 GROUP BY event_id),
    e AS (SELECT event_id, event_id % 6 AS d, event_id % 4 AS n, CAST(event_id % 101 AS INTEGER) AS pc, CAST(event_id % 51 AS INTEGER) AS sv FROM events),
    x AS (SELECT e.*, kf, CASE WHEN n > 0 THEN ' Analysis backed by ' || n || ' historical records.' ELSE '' END AS note FROM e JOIN k USING (event_id))
    SELECT event_id, CASE d WHEN 0 THEN 'Asteroid observation analysis: seen (confidence: ' || pc || '%).' || kf || note
      WHEN 1 THEN 'Land change detection: seen detected (confidence: ' || pc || '%).' || kf || note
      WHEN 2 THEN 'Drought assessment: seen — severity score ' || (sv // 10) || '.' || (sv % 10) || '/5.0 (confidence: ' || pc || '%).' || kf || note
      WHEN 3 THEN 'ISRO mission query processed.' || note WHEN 4 THEN 'Multi-domain analysis complete.' || kf || note ELSE 'Analysis complete.' END AS answer FROM x""",
)
def answer_text(t):
    """Answer sentence of every event treated as a question of some domain."""
    k = F.col("event_id")
    dom = F.get(F.array(*[F.lit(d) for d in ("astronomy", "earth_obs", "climate", "isro", "multi", "none")]), (k % 6).cast("int"))
    out = text.answer(dom, F.lit("seen"), (k % 101) / F.lit(100.0), (k % 51) / F.lit(10.0), F.col("top"), k % 4)
    return _attributions(t).select("event_id", out.alias("answer"))


@query(
    "evidence_hash",
    "F21 F22",
    """SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"n_chars":' || length(text) || ',"role":"' || role || '","turn":' || turn || '}') AS evidence,
      'prediction:' || md5('{"role":"' || role || '","turn":' || turn || '}') AS cache_key FROM conversations""",
)
def evidence_hash(t):
    """Evidence digest and cache key of every conversation turn."""
    fields = {"turn": F.col("turn"), "role": F.col("role"), "conv_id": F.col("conv_id"), "n_chars": F.length("text")}
    return t.conversations.select(
        "conv_id",
        "turn",
        hashing.evidence_hash(fields).alias("evidence"),
        hashing.cache_key("prediction", {"turn": F.col("turn"), "role": F.col("role")}).alias("cache_key"),
    )


@query(
    "ledger_verify",
    "W3",
    """SELECT id, agent_name, prev_hash IS NOT DISTINCT FROM lag(output_hash) OVER (PARTITION BY agent_name ORDER BY id) AS valid FROM ledger""",
    ("ledger",),
)
def ledger_verify(t):
    """Whether each ledger row holds the output hash of the row before it."""
    return ledger.verify(_ledger(t), ["agent_name"], ["id"]).select("id", "agent_name", "valid")


def _ledger(t):
    rows = t.events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("agent_name"),
        F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type"))).alias("output_hash"),
    )
    broken = F.when(F.col("id") % 137 == 5, F.md5(F.lit("broken"))).otherwise(F.col("prev_hash"))
    return ledger.chain(rows, ["agent_name"], ["id"]).withColumn("prev_hash", broken)


@query("ledger_chain", "W3 F21", "SELECT id, agent_name, output_hash, prev_hash FROM ledger", ("ledger",))
def ledger_chain(t):
    """Chain of the events per agent, with some links broken."""
    return _ledger(t).select("id", "agent_name", "output_hash", "prev_hash")


_SEQ = "s AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


def _log_sql(limit, window, columns):
    w = int(window * 1_000_000)
    return f"""WITH RECURSIVE {_SEQ}, r AS (
      SELECT user_id, k, event_id, TRUE AS allowed, [us] AS log FROM s WHERE k = 1
      UNION ALL SELECT user_id, k, event_id, len(kept) < {limit}, CASE WHEN len(kept) < {limit} THEN list_append(kept, us) ELSE kept END
      FROM (SELECT s.user_id, s.k, s.event_id, s.us, list_filter(r.log, lambda x: x > s.us - {w}) AS kept FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1))
    SELECT {columns} FROM r"""


@query(
    "rate_limit_sliding",
    "W10",
    _log_sql(3, 36 * 3600, "user_id, event_id, allowed, CAST(greatest(0, 3 - len(log)) AS INTEGER) AS remaining"),
)
def rate_limit_sliding(t):
    """Three calls per 36 hours per user, rejected calls not counting."""
    out = limiter.sliding_log(t.events, "user_id", "event_id", "ts", 3, 36 * 3600)
    return out.select(F.col("key").alias("user_id"), F.col("event").alias("event_id"), "allowed", "remaining")


@query(
    "rate_limit_token",
    "W11",
    f"""WITH RECURSIVE {_SEQ}, r AS (
      SELECT user_id, k, event_id, us, TRUE AS allowed, CAST(3 AS DOUBLE) AS tokens FROM s WHERE k = 1
      UNION ALL SELECT user_id, k, event_id, us, full_ >= 1, CASE WHEN full_ >= 1 THEN full_ - 1 ELSE full_ END
      FROM (SELECT s.user_id, s.k, s.event_id, s.us, least(CAST(4 AS DOUBLE), r.tokens + (s.us - r.us) / 1e6::DOUBLE * (0.001::DOUBLE / 60.0::DOUBLE)) AS full_ FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1))
    SELECT user_id, event_id, allowed, round(tokens, 6) AS remaining FROM r""",
)
def rate_limit_token(t):
    """Token bucket with burst 4 and a slow refill per user."""
    out = limiter.token_bucket(t.events, "user_id", "event_id", "ts", 0.001, 4)
    return out.select(F.col("key").alias("user_id"), F.col("event").alias("event_id"), "allowed", F.round("remaining", 6).alias("remaining"))


@query("request_reuse", "V3", _log_sql(1, 12 * 3600, "user_id, event_id, allowed AS computed"))
def request_reuse(t):
    """Requests answered from an answer younger than 12 hours, and those computed anew."""
    out = limiter.cached_requests(t.events, "user_id", "event_id", "ts", 12 * 3600)
    return out.select(F.col("key").alias("user_id"), F.col("event").alias("event_id"), "computed")
