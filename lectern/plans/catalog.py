"""All registered queries and their oracles."""

from __future__ import annotations

from functools import cache

from lectern.plans import entity_queries, io_queries, model_queries, score_queries, stat_queries
from lectern.plans.registry import Registry

SECTIONS = (entity_queries, score_queries, model_queries, stat_queries, io_queries)


@cache
def catalog() -> Registry:
    registry = Registry()
    for section in SECTIONS:
        section.register(registry)
    return registry
