"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

import importlib

PARTS = ("retrieval_queries", "tree_queries", "token_queries", "table_queries")


def _parts():
    return [importlib.import_module(f"coppice.plans.{p}") for p in PARTS]


def queries() -> dict:
    """Name to callable of session and folder."""
    return {f.__name__: f for part in _parts() for f in part.QUERIES}


def oracle_sql() -> dict:
    """Name to the equivalent SQL, where SQL can express it over whole tables."""
    return {name: sql for part in _parts() for name, sql in part.SQL.items()}
