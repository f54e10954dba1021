"""Registered queries, grouped by area."""

from importlib import import_module

AREAS = ("quality", "relational", "features", "geospatial", "sky_text", "vector_graph", "models", "evaluation", "storage")


def load_all() -> None:
    for area in AREAS:
        import_module(f"tidemark.plans.{area}")
