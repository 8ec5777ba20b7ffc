"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfield.session import shared_folder

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col, modulus: int):
    """crc32 of an id written as text, modulo a number; null for a null id."""
    return F.expr(f"crc32(cast(cast({col} as string) as binary)) % {modulus}")


def held_out(col: str, modulus: int, rest: int):
    """Whether a row is kept from training; a row without an id never is."""
    return F.coalesce(remainder(col, modulus) == rest, F.lit(False))


def spot(col: str):
    """A number in [0, 1) that depends on the id only: the same rows are drawn at every run."""
    return F.expr(f"pmod(xxhash64('draw', cast({col} as string)), 1000003) / 1000003D")


def drawn(df: DataFrame, id_col: str, group: str, most: int) -> DataFrame:
    """About ``most`` rows of every group, by ``spot``; all rows of a group that has no more.

    The share is computed from the counts of the groups (a few classes), so no group is sorted
    and no row set is gathered.
    """
    counts = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    share = F.lit(0.0)
    for k, n in counts.items():
        if k is not None:
            share = F.when(F.col(group) == F.lit(k), F.lit(min(1.0, most / n))).otherwise(share)
    return df.where(spot(id_col) < share)


def staged(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read again.

    Later steps read the files, so a lost executor costs no recomputation of what led there, and
    values drawn per task (ordinals, partition numbers) stay as they were written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
