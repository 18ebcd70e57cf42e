"""Registered queries, one per operator."""

import importlib

AREAS = ["catalog", "timeline", "ingest", "layout", "text", "plan", "stream"]


def _load():
    for area in AREAS:
        importlib.import_module(f"lectern.queries.{area}")


def all_queries():
    from lectern.queries.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from lectern.queries.registry import ORACLE

    _load()
    return dict(ORACLE)
