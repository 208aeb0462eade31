"""Queries and oracles of the engine's own operators."""

from __future__ import annotations

from quarry.plans import documents, search, stages

QUERIES = documents.QUERIES | search.QUERIES | stages.QUERIES
ORACLES = documents.ORACLES | search.ORACLES | stages.ORACLES
