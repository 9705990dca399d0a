"""Registry of the co-clustering queries and their SQL twins."""

from __future__ import annotations

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
