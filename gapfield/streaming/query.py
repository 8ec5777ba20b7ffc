"""Point streams against a stored field."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.query import query


def query_stream(
    points: DataFrame, fields: DataFrame, voxels: DataFrame | None = None, mode: str = "second",
    cells: DataFrame | None = None, table: DataFrame | None = None,
) -> DataFrame:
    """Stream-static joins in any mode, without an aggregation.

    The cell modes take the cell table, the mode with candidates the candidate table as well, so each point meets
    one row and no state is kept.
    """
    if mode in ("trilinear", "tricubic", "candidates") and cells is None:
        raise ValueError(f"mode {mode!r} on a stream needs the cell table")
    if mode == "candidates" and table is None:
        raise ValueError("candidates on a stream need the candidate table")
    return query(points, fields, voxels, mode, cells=cells, table=table)
