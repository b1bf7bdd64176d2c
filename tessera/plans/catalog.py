"""All registered queries of the library, and their SQL twins."""

from __future__ import annotations

from tessera.plans import cases, changes, graphs, metrics, more, structures, text, tools, trees  # noqa: F401
from tessera.plans.registry import QUERIES, SQL, Tables


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def flagship(spark, sf_dir):
    """BM25 top ten over all documents."""
    return text.bm25_search_top10(Tables(spark, sf_dir))
