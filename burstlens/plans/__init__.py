"""Registered queries over the given tables, each next to its reference SQL."""

from burstlens.plans import (  # noqa: F401  (registration happens on import)
    dataset_queries,
    localization_queries,
    pixel_queries,
    scoring_queries,
    source_queries,
)
from burstlens.plans.registry import oracles, queries

__all__ = ["oracles", "queries"]
