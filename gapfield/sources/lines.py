"""Text files as ordered lines, without loading a file in one piece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ("block", "pos")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, pos, line)``: ``(block, pos)`` orders the lines of a file.

    ``block`` is the byte offset of the input split, ``pos`` increases within it, so a big file
    stays split over many tasks and serves as the bucket of the running values.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )
