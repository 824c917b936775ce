"""Queries of the library, by name, with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from sylvane.plans import model_queries, text_queries, vector_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (text_queries, vector_queries, model_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark, sf_dir):
    """A topic tree over the documents: its nodes with questions and sizes."""
    return QUERIES["topic_tree_build"](spark, sf_dir)
