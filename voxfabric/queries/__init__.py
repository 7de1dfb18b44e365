"""Registered queries: each applies operators to whole derived tables, most with the same result in SQL."""

from voxfabric.queries import catalog, geometry, render, scene, screen, state, stores, volumes
from voxfabric.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "geometry", "render", "scene", "screen", "state", "stores", "volumes"]
