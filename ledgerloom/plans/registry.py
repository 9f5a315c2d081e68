"""All queries of the library proper, by name, with their DuckDB oracles."""

from __future__ import annotations

from . import analytics, documents, reporting, scalars, storage
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "documents", "reporting", "scalars", "storage"]
