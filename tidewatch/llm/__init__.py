"""Training-data operators and their registered queries; nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

SUBJECTS = ["token_file", "decontaminate", "language", "search", "shards", "pieces", "secrets", "chat", "near_copies",
            "repeats", "variants", "passages", "alignment"]


def load():
    """(queries, sql) of all operators here."""
    for subject in SUBJECTS:
        import_module(f"tidewatch.llm.{subject}")
    from tidewatch.llm.base import QUERIES, SQL

    return QUERIES, SQL
