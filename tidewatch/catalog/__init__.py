"""Registered queries, grouped by subject."""

from __future__ import annotations

from importlib import import_module

SUBJECTS = ["features", "operations", "search", "modelling", "streams"]


def load():
    """(queries, sql) of all subjects."""
    for subject in SUBJECTS:
        import_module(f"tidewatch.catalog.{subject}")
    from tidewatch.catalog.base import QUERIES, SQL

    return QUERIES, SQL
