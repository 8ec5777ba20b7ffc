"""Importing this module registers every query."""

from . import builds, contacts, evaluation, fields, files, geometry, signals, sources, streams, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
