"""Registered queries of the masking library and their oracle SQL."""

from __future__ import annotations

from maskline.queries import harvesting, mapping, masking, runs, scalars  # noqa: F401  (they register)
from maskline.queries.base import ORACLES, QUERIES

FLAGSHIP = "mask_documents"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
