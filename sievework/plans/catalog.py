"""All registered queries."""

from sievework.plans import (  # noqa: F401
    catalog_features,
    catalog_frame,
    catalog_graph,
    catalog_metrics,
    catalog_models,
    catalog_sources,
    catalog_split,
    screening,
)
from sievework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
