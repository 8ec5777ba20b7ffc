"""Rows of a stream appended to a folder, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

BATCH = "batch_id"


def append_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", after: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Write every batch to a folder of its own, named by its id.

    Spark runs a batch again after a failure, with the same id and the same rows; it then replaces its folder, so
    no row is written twice and nothing of a torn write stays. ``after`` is called with the id of a written batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite").format(fmt)
        (w.option("header", True) if fmt == "csv" else w).save(f"{path}/{BATCH}={batch_id}")
        if after is not None:
            after(batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_appended(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The rows of all batches, with the batch that wrote them."""
    r = spark.read.schema(StructType([*schema.fields, StructField(BATCH, LongType())])).format(fmt)
    return (r.option("header", True) if fmt == "csv" else r).load(path)
