"""All registered queries of the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from sievework.plans import code, datasets, findings, reviews, scan, scores, spans, training  # noqa: F401  (each registers its queries)
from sievework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
