"""All registered queries."""

from __future__ import annotations

from barloom.plans import (  # noqa: F401  (registers on import)
    feature_queries,
    indicator_queries,
    market_queries,
    trading_queries,
)
from barloom.plans.registry import CATALOG

__all__ = ["CATALOG"]
