"""Registered queries and the pipelines they run."""

from __future__ import annotations

import importlib

from tidemark.plans.registry import ORACLES, QUERIES

QUERY_MODULES = ("window_queries", "table_queries", "selection_queries", "compare_queries", "model_queries", "feature_queries", "ingest_queries", "matrix_queries")


def load_queries():
    for name in QUERY_MODULES:
        importlib.import_module(f"tidemark.plans.{name}")
    return dict(QUERIES), dict(ORACLES)
