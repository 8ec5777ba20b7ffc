"""Field tables on disk: write, read, and block-ordered layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import IJK
from ..operators.query import STORED, stored_block

BLOCK_ORDER = ("bk", "bj", "bi", "k", "j", "i")


def block_order(voxels: DataFrame) -> DataFrame:
    """Voxels of a field range-partitioned and sorted by block, z first.

    Range partitioning on (field, block) spreads one big field over many files and gives every
    file tight statistics on the block columns.
    """
    cols = [c for c in BLOCK_ORDER if c in voxels.columns]
    return voxels.repartitionByRange("field_id", *[c for c in cols if c.startswith("b")]).sortWithinPartitions(
        "field_id", *cols
    )


#: Folders that the fields of a store are dealt to; their number does not grow with the fields.
FOLDERS = 64
FOLDER = "field_folder"


def _folder(field_id: Column) -> Column:
    return F.pmod(F.xxhash64(field_id.cast("string")), F.lit(FOLDERS)).cast("int")


def write_field(
    fields: DataFrame, voxels: DataFrame, path: str, candidates: DataFrame | None = None, mode: str = "append"
) -> None:
    """``path/fields``, ``path/voxels`` and ``path/candidates``, dealt to folders by hashed field id."""
    fields.write.mode(mode).parquet(f"{path}/fields")
    dealt = block_order(voxels).withColumn(FOLDER, _folder(F.col("field_id")))
    dealt.write.mode(mode).partitionBy(FOLDER).parquet(f"{path}/voxels")
    if candidates is not None:
        c = candidates.repartitionByRange("field_id", "k", "j", "i").sortWithinPartitions("field_id", "k", "j", "i", "rank")
        c.withColumn(FOLDER, _folder(F.col("field_id"))).write.mode(mode).partitionBy(FOLDER).parquet(f"{path}/candidates")


def _read(spark: SparkSession, path: str, field_id) -> DataFrame:
    d = spark.read.parquet(path)
    if field_id is None:
        return d.drop(FOLDER)
    # the folder, a constant once the plan is optimized, prunes the files, the sorted id the row groups in them
    return d.filter((F.col(FOLDER) == _folder(F.lit(field_id))) & (F.col("field_id") == F.lit(field_id))).drop(FOLDER)


def read_field(spark: SparkSession, path: str, field_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``fields`` and ``voxels``; one field id prunes to its folder."""
    f = spark.read.parquet(f"{path}/fields")
    if field_id is not None:
        f = f.filter(F.col("field_id") == F.lit(field_id))
    return f, _read(spark, f"{path}/voxels", field_id)


def read_candidates(spark: SparkSession, path: str, field_id: str | None = None) -> DataFrame:
    """The candidates of a store; one field id prunes to its folder."""
    return _read(spark, f"{path}/candidates", field_id)


def append_rows(q: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append audit or benchmark rows; ``fmt`` is parquet, csv or json."""
    w = q.write.mode("append").format(fmt)
    (w.option("header", True) if fmt == "csv" else w).save(path)


# ---- bucketed tables -------------------------------------------------------------------------


def write_bucketed(rows: DataFrame, table: str, path: str, buckets: int, dealt: bool = False) -> None:
    """Voxels or cells as a table bucketed by field and block, one file per bucket.

    A query of such a table shuffles its points to the buckets, never the stored rows
    (``spark.sql.requireAllClusterKeysForCoPartition`` must be false, as in :mod:`session`). Take as
    many buckets as a query has shuffle partitions or more. A field spreads over all buckets by its blocks.
    ``dealt`` rows, such as cells made for as many buckets, lie in one partition per bucket already and are not shuffled again.
    """
    d = rows.withColumn(STORED, stored_block([F.col(n).cast("bigint") for n in IJK]))
    if not dealt:
        d = d.repartition(buckets, "field_id", STORED)
    d.write.mode("overwrite").option("path", path).bucketBy(buckets, "field_id", STORED).sortBy("field_id", STORED).format("parquet").saveAsTable(table)


def attach_bucketed(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """A table that :func:`write_bucketed` wrote, named in a session that does not know it."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ddl}) USING parquet CLUSTERED BY (field_id, {STORED}) SORTED BY (field_id, {STORED}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
