"""Registered queries, grouped like the operator modules."""

from __future__ import annotations

import importlib

from variascope.registry import QUERIES, SQL

GROUPS = ("sources", "calls", "coverage", "annotate", "tree", "taxa", "evolution", "series", "assay")


def load():
    """Import every group once and return (queries, sql)."""
    for group in GROUPS:
        importlib.import_module(f"variascope.catalog.{group}")
    return QUERIES, SQL
