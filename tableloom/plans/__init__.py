"""Queries over the given tables, composed of the operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("catalog_queries", "profile_queries", "shape_queries", "join_queries", "feature_queries", "similarity_queries", "model_queries", "workflows")


def load_queries() -> tuple[dict, dict]:
    """All queries by name, and the SQL of those that SQL can express."""
    from tableloom.plans.base import QUERIES, SQL

    for name in MODULES:
        import_module(f"tableloom.plans.{name}")
    return dict(QUERIES), dict(SQL)
