"""Queries over the engine's own operators."""

from __future__ import annotations

from . import queries_tasks  # noqa: F401  registers its queries
from .queries import QUERIES, SQL


def flagship(spark, sf_dir):
    return QUERIES["complete_delta_events"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
