"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import importlib

GROUPS = ("text_queries", "exact_queries", "pii_queries", "shard_queries", "warc_queries", "near_queries", "piece_queries", "passage_queries", "period_queries", "spelling_queries", "trie_queries", "pipeline_queries")


def load():
    """(queries, sql)."""
    queries, sql = {}, {}
    for group in GROUPS:
        module = importlib.import_module(f"variascope.llm.{group}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
