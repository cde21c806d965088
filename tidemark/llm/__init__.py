"""Operators of a training-data pipeline and their registered queries."""

from __future__ import annotations


def load_queries():
    """(queries by name, SQL by name)."""
    from tidemark.llm import queries

    return dict(queries.QUERIES), dict(queries.ORACLES)
