"""Registered queries, grouped by area."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, Query

AREAS = ("catalog", "baskets", "ingest", "monitor", "refresh", "identity", "audits", "streams", "writes")


def load() -> dict[str, Query]:
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return QUERIES
