"""All registered queries."""

from __future__ import annotations

from panelspark.plans import queries_checks, queries_external, queries_features, queries_graph, queries_metrics, queries_models, queries_panel, queries_post  # noqa: F401
from panelspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
