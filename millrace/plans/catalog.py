"""All queries of the library proper."""

from __future__ import annotations

from . import coercions, enrichment, exports, extraction, more, page_trees, pages, products, relational, rivals, rollups, scalars, trees  # noqa: F401  (they register)
from .registry import ORACLE, QUERIES  # noqa: F401
