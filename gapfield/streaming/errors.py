"""Running signal errors over event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import ratio


def windowed_error(
    stream: DataFrame, width: str, keys: Sequence[str], slide: str | None = None, delay: str = "1 minute"
) -> DataFrame:
    """Errors of aligned rows ``(keys, ts, ref, own)`` per tumbling or sliding window."""
    diff = F.col("own") - F.col("ref")
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    d = stream.withWatermark("ts", delay).groupBy(win.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("num_points"), F.sum(diff * diff).alias("_ss"), F.max(F.abs(diff)).alias("max_abs_error"),
        F.avg(F.abs(diff)).alias("mean_abs_error"), (F.max("ref") - F.min("ref")).alias("_range"),
    )
    rmse = F.sqrt(F.col("_ss") / F.col("num_points"))
    norm = F.when(F.col("_range") > 1e-30, ratio(rmse, F.col("_range"))).otherwise(0.0)
    return d.select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "num_points", rmse.alias("rmse"),
        "max_abs_error", "mean_abs_error", norm.alias("normalized_rmse"),
    )


def contact_episodes(
    stream: DataFrame, gap: str, keys: Sequence[str] = ("run_id", "cp_id"), delay: str = "1 minute"
) -> DataFrame:
    """Episodes of touching rows of a measure stream: sessions split by ``gap`` of silence."""
    touch = stream.filter(F.col("gap") <= 0).withWatermark("ts", delay)
    d = touch.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("rows"), F.max("penetration").alias("max_penetration")
    )
    return d.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "max_penetration")
