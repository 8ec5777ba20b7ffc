"""Query points derived from fields and stored blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import AXES
from ..operators.ordered import running
from ..session import spread


def lattice_points(fields: DataFrame) -> DataFrame:
    """5 x 5 x 5 points over the middle 60 percent of every field."""
    d = fields.withColumn("qid", F.explode(F.sequence(F.lit(0), F.lit(124))))
    steps = (F.floor(F.col("qid") / 25), F.pmod(F.floor(F.col("qid") / 5), F.lit(5)), F.pmod("qid", F.lit(5)))
    cols = []
    for a, s in zip(AXES, steps):
        lo, hi = F.col(f"bmin{a}"), F.col(f"bmax{a}")
        cols.append(((lo + hi) * 0.5 + (s * 0.5 - 1.0) * (hi - lo) * 0.3).alias(a))
    return d.select("field_id", F.col("qid").cast("bigint").alias("qid"), *cols)


def _spread(df: DataFrame, n: int, name: str = "qid", step: int = 4096) -> DataFrame:
    """``n`` rows per input row, expanded in two steps so that no single array is large."""
    d = df.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((n - 1) // step).cast("bigint"))))
    d = spread(d, "field_id", "_c")
    last = F.least(F.col("_c") * step + (step - 1), F.lit(n - 1).cast("bigint"))
    return d.withColumn(name, F.explode(F.sequence(F.col("_c") * step, last))).drop("_c")


def unit_number(*parts) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an md5 over the joined parts."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def random_points(fields: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` uniform points per field inside the range where every mode is valid.

    A unit number is a hash of (field, point, axis, seed), so any split of the work gives the
    same points.
    """
    d = _spread(fields, n)
    cols = []
    for q, a in enumerate(AXES):
        dim = F.col(f"dim{a}")
        lo = F.when(dim > 3, 0.05).otherwise(0.0)
        hi = F.when(dim > 3, dim - 1.05).otherwise(0.0)
        u = unit_number("field_id", "qid", q, seed)
        cols.append((F.col(f"bmin{a}") + F.col(f"vox{a}") * (lo + (hi - lo) * u + 0.5)).alias(a))
    return d.select("field_id", "qid", *cols)


def block_points(voxels: DataFrame, fields: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` points per field dealt evenly over its stored blocks, uniform within each block.

    Blocks are numbered by running counts over layers of equal ``bk``; block r of m makes the
    points r, r + m, r + 2 m and so on, so points and blocks are never joined.
    """
    blocks = voxels.select("field_id", "bi", "bj", "bk").distinct()
    layers = blocks.groupBy("field_id", "bk", "bj").agg(F.count("bi").alias("_size"))
    ahead = running(layers, ["field_id"], ["bk", "bj"], F.col("bk"), sums={"_upto": F.col("_size")}).select("field_id", "bk", "bj", (F.col("_upto") - F.col("_size")).alias("_ahead"))
    row = Window.partitionBy("field_id", "bk", "bj").orderBy("bi")
    count = layers.groupBy("field_id").agg(F.sum("_size").alias("_m"))
    d = blocks.withColumn("_in", F.row_number().over(row) - 1).join(ahead, ["field_id", "bk", "bj"]).join(count, "field_id")
    d = spread(d.withColumn("_r", (F.col("_ahead") + F.col("_in")).cast("bigint")).where(F.col("_r") < n), "field_id", "_r")
    d = d.withColumn("qid", F.explode(F.sequence(F.col("_r"), F.lit(n - 1).cast("bigint"), F.col("_m").cast("bigint"))))
    d = d.join(fields, "field_id")
    cols = []
    for q, (a, b) in enumerate(zip(AXES, ("bi", "bj", "bk"))):
        first = F.col(b) * F.col("block_dim")
        size = F.least(F.col("block_dim"), F.col(f"dim{a}") - first)
        cols.append((F.col(f"bmin{a}") + F.col(f"vox{a}") * (first + size * unit_number("field_id", "qid", q, seed))).alias(a))
    return d.select("field_id", "qid", *cols)
