"""All queries over the driver's tables."""

from __future__ import annotations

from corpusmill.plans import corpus, extras, history, projects, retrieval  # noqa: F401  (they register their queries)
from corpusmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
