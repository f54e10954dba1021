"""Routing, task and answer texts as Column expressions over whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords per domain, tested in this order.
DOMAIN_KEYWORDS = {
    "astronomy": ["asteroid", "satellite", "iss", "orbit", "star", "planet", "telescope", "observation", "magnitude", "conjunction"],
    "earth_obs": ["ndvi", "deforestation", "land", "vegetation", "change detection", "satellite imagery", "urbanization", "forest"],
    "climate": ["drought", "rainfall", "soil moisture", "crop", "agriculture", "flood", "precipitation", "weather"],
    "isro": ["isro", "chandrayaan", "mangalyaan", "aditya", "launch", "mission"],
}
# Vector table and agent per domain; ``multi`` is the rest.
DOMAIN_TABLE = {
    "astronomy": "asteroid_obs_embeddings",
    "earth_obs": "change_event_embeddings",
    "climate": "drought_event_embeddings",
    "isro": "graph_node_embeddings",
    "multi": "graph_node_embeddings",
}
DOMAIN_AGENT = {
    "astronomy": "AstroAgent",
    "earth_obs": "SatelliteChangeAgent",
    "climate": "DroughtAgent",
    "isro": "ISROAgent",
    "multi": "GraphRAGAgent",
}
# Data sources per domain.
DOMAIN_SOURCES = {
    "astronomy": ["NASA JPL SSD API", "Open-Meteo", "Minor Planet Center"],
    "earth_obs": ["Sentinel Hub (Copernicus)", "Google Earth Engine", "NASA AppEEARS"],
    "climate": ["NASA SMAP", "Copernicus ERA5", "IMD"],
    "isro": ["ISRO MOSDAC", "N2YO API"],
    "multi": ["pgvector GraphRAG", "All domain sources"],
}
# Keywords per task agent, and the agents' priorities.
AGENT_KEYWORDS = {
    "data": ["data", "ingest", "load", "validate", "clean", "preprocess", "transform", "merge", "csv", "json", "dataset", "quality"],
    "ml": [
        "model", "train", "predict", "ml", "machine learning", "evaluate", "accuracy", "classification", "regression", "feature",
        "hyperparameter",
    ],
    "geo": [
        "location", "geocode", "map", "distance", "coordinates", "latitude", "longitude", "spatial", "gis", "geographic", "route",
        "nearby",
    ],
}
AGENT_PRIORITY = {"data": 3, "geo": 2, "ml": 2}
AGENT_LABEL = {"data": "data", "ml": "ML", "geo": "geospatial"}


def has_any(lowered: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def domain(text: Column) -> Column:
    """First domain one of whose keywords occurs in the text, else ``multi``."""
    low = F.lower(text)
    out = None
    for name, words in DOMAIN_KEYWORDS.items():
        out = F.when(has_any(low, words), name) if out is None else out.when(has_any(low, words), name)
    return out.otherwise("multi")


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.element_at(pairs, key)
    return found if default is None else F.coalesce(found, default)


def sources(key: Column, default: list[str] | None = None) -> Column:
    """Data sources of a domain."""
    pairs = F.create_map(*[x for k, v in DOMAIN_SOURCES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(F.element_at(pairs, key), F.array(*[F.lit(s) for s in default or ["unknown"]]))


def agents(task: Column) -> Column:
    """All agents whose keywords occur in the task; ``data`` when none does."""
    low = F.lower(task)
    hit = F.filter(F.array(*[F.when(has_any(low, words), name) for name, words in AGENT_KEYWORDS.items()]), lambda x: x.isNotNull())
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("data")))


def complexity(agent_list: Column) -> Column:
    n = F.size(agent_list)
    return F.when(n == 1, "simple").when(n <= 3, "moderate").otherwise("complex")


def subtasks(task: Column, agent_list: Column) -> Column:
    """``struct(agent, task, priority)`` per agent, highest priority first, ties in agent order."""
    keyed = F.transform(
        agent_list,
        lambda a, i: F.struct(
            (-F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in AGENT_PRIORITY.items() for x in kv]), a), F.lit(1))).alias("rank"),
            i.alias("position"),
            a.alias("agent"),
            F.concat(F.lit("Handle all "), lookup(a, AGENT_LABEL, a), F.lit(" operations for: "), task).alias("task"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["agent"].alias("agent"), x["task"].alias("task"), (-x["rank"]).alias("priority")))


def top_attributions(values: Column, k: int) -> Column:
    """The k entries of a map with the largest absolute value, ties by name."""
    keyed = F.transform(
        F.map_entries(values), lambda e: F.struct((-F.abs(e["value"])).alias("rank"), e["key"].alias("name"), e["value"].alias("value"))
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


# The sentence texts.
def attribution_sentence(top: Column) -> Column:
    """``x increased the prediction. y decreased the prediction.`` from the first two entries."""
    parts = F.transform(
        F.slice(top, 1, 2),
        lambda e: F.concat(spaced(e["name"]), F.when(e["value"] > 0, " increased").otherwise(" decreased"), F.lit(" the prediction")),
    )
    return F.when(F.size(top) > 0, F.concat(F.array_join(parts, ". "), F.lit("."))).otherwise("No feature attribution available.")


# The sentence texts.
def key_factors(top: Column) -> Column:
    """`` Key factors: x (positive impact), ...`` from the first three entries, or nothing."""
    parts = F.transform(
        F.slice(top, 1, 3),
        lambda e: F.concat(spaced(e["name"]), F.lit(" ("), F.when(e["value"] > 0, "positive").otherwise("negative"), F.lit(" impact)")),
    )
    return F.when(F.size(top) > 0, F.concat(F.lit(" Key factors: "), F.array_join(parts, ", "), F.lit("."))).otherwise("")


def percent0(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("bigint").cast("string"), F.lit("%"))


# The sentence texts.
def answer(dom: Column, label: Column, confidence: Column, severity: Column, top: Column, records: Column) -> Column:
    """The answer sentence of each domain."""
    factors = key_factors(top)
    note = F.when(records > 0, F.concat(F.lit(" Analysis backed by "), records.cast("string"), F.lit(" historical records."))).otherwise("")
    sure = F.concat(F.lit("(confidence: "), percent0(F.coalesce(confidence, F.lit(0.0))), F.lit(")."))
    score = F.format_string("%.1f", F.bround(F.coalesce(severity, F.lit(0.0)), 1))
    return (
        F.when(dom == "astronomy", F.concat(F.lit("Asteroid observation analysis: "), F.coalesce(label, F.lit("uncertain")), F.lit(" "), sure, factors, note))
        .when(dom == "earth_obs", F.concat(F.lit("Land change detection: "), F.coalesce(label, F.lit("no_change")), F.lit(" detected "), sure, factors, note))
        .when(
            dom == "climate",
            F.concat(F.lit("Drought assessment: "), F.coalesce(label, F.lit("normal")), F.lit(" — severity score "), score, F.lit("/5.0 "), sure, factors, note),
        )
        .when(dom == "isro", F.concat(F.lit("ISRO mission query processed."), note))
        .when(dom == "multi", F.concat(F.lit("Multi-domain analysis complete."), factors, note))
        .otherwise("Analysis complete.")
    )
