"""Queries over the TPC-H-like tables, each beside its SQL oracle."""

from tessera.queries import cleaning, enrichment, groups, models, search, slots, sources  # noqa: F401
from tessera.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
