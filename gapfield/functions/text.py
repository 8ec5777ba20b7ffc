"""Small text helpers shared by the text sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_comment(line: Column, mark: str = "#") -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, mark + ".*$", ""), r"\s+", " "))


def numbers(text: Column) -> Column:
    """Numbers of a comma or blank separated list; a trailing ``D`` is dropped, bad tokens skipped."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"[,\s]+")
    vals = F.transform(parts, lambda p: F.regexp_replace(p, "D+$", "").try_cast("double"))
    return F.filter(vals, lambda v: v.isNotNull())


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, r"^[' ]+|[' ]+$", "")


def truth(text: Column) -> Column:
    return F.upper(text).isin("TRUE", "1")


def sanitize(name: Column) -> Column:
    """Signal name that is safe as a file name."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_")
