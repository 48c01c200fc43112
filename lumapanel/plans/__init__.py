"""Registered queries over the driver tables."""

from importlib import import_module

from .registry import ORACLES, QUERIES

GROUPS = ("pixel_queries", "spatial_queries", "trend_queries", "census_queries", "observation_queries", "table_queries")


def _load() -> None:
    for group in GROUPS:
        import_module(f"{__name__}.{group}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
