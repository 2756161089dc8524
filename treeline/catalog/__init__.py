"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("files_queries", "tree_queries", "plan_queries", "telemetry_queries", "similarity_queries",
           "surface_queries")


def load():
    """Import the query modules and return the module with QUERIES and ORACLES."""
    for name in MODULES:
        import_module(f"treeline.catalog.{name}")
    return import_module("treeline.catalog.data")
