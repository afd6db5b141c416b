"""Registered queries over the shared test tables, each with its SQL twin."""

from importlib import import_module

MODULES = ["clock_queries", "feature_queries", "point_queries", "series_queries", "score_queries", "ingest_queries", "plan_queries"]


def load():
    """Import the query modules and return the filled registry."""
    for name in MODULES:
        import_module(f"settlespark.workload.{name}")
    return import_module("settlespark.workload.registry")
