"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the plans in this package are written for; all are ordinary Spark SQL options.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # lets a table bucketed by block serve a join on block and voxel without a new shuffle
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    A scratch folder stands in for it where driver and executors are one process; on a cluster
    a missing setting is an error, because other machines could not read such a folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def task_slots(spark: SparkSession) -> int:
    """Partitions for rows that are dealt by hand: the shuffle's number, all cores at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def grown(df: DataFrame) -> DataFrame:
    """A join side whose rows were grown from few, such as the voxels of fields: met by sorting both sides.

    Spark sizes the output of an explode by its input, so it would take such a side for small and
    send all of it through the driver as a broadcast.
    """
    return df.hint("merge")


def spread(df: DataFrame, *cols) -> DataFrame:
    """Hash rows over all task slots before each of them grows into many.

    The partition count is explicit, because adaptive execution would otherwise merge the few
    small input rows back into one task and the growth would happen there.
    """
    return df.repartition(task_slots(df.sparkSession), *cols)
