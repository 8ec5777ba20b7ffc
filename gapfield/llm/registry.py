"""The queries of this subpackage; importing this module registers all of them."""

from __future__ import annotations

from . import queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries"]
