"""Signals as many ``time,value`` text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitize


def read_signals(spark: SparkSession, root: str) -> DataFrame:
    """``signals(scenario, category, entity, component, t, value)``.

    The folder names the scenario and the file ``Category_Entity_Component.csv`` the rest; the
    entity may itself contain underscores.
    """
    raw = (
        spark.read.option("header", True).schema("time double, value double")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
        .select("*", F.col("_metadata.file_path").alias("_p"))
    )
    name = F.regexp_extract("_p", r"([^/]+)\.csv$", 1)
    parts = F.split(name, "_")
    n = F.size(parts)
    return raw.select(
        F.regexp_extract("_p", r"([^/]+)/[^/]+$", 1).alias("scenario"), parts[0].alias("category"),
        F.when(n > 2, F.array_join(F.slice(parts, F.lit(2), n - 2), "_")).otherwise("").alias("entity"),
        F.when(n > 1, F.element_at(parts, -1)).otherwise("").alias("component"),
        F.col("time").alias("t"), "value",
    )


def write_signals(q: DataFrame, root: str) -> None:
    """One folder per scenario and signal with ``time,value`` files in time order.

    Range partitioning on (signal, t) lets a long signal be written by several tasks.
    """
    name = sanitize(F.concat_ws("_", "category", "entity", "component"))
    d = q.select("scenario", name.alias("signal"), F.col("t").alias("time"), "value")
    d.repartitionByRange("scenario", "signal", "time").sortWithinPartitions("scenario", "signal", "time").write.mode(
        "overwrite"
    ).option("header", True).partitionBy("scenario", "signal").csv(root)


def read_written_signals(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("header", True).schema("time double, value double, scenario string, signal string").csv(root)
