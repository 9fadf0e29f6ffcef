"""The query catalogue: every query with its DuckDB oracle."""

from __future__ import annotations

from .plans import images, kernels, matching, robust, sky, transforms  # noqa: F401  each module registers its queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
