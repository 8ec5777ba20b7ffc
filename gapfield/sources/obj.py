"""Triangle meshes as OBJ text: bulk read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import AXES
from ..operators.ordered import running
from .lines import ORDER, read_lines


def mesh_name(path_col):
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path_col, r"([^/]+)$", 1), r"\.[^.]*$", "")


def read_obj(
    spark: SparkSession, path: str | list[str], longer_faces: str = "first3"
) -> tuple[DataFrame, DataFrame]:
    """``vertices(mesh_id, vid, x, y, z)`` and ``faces(mesh_id, tri_id, v0, v1, v2)`` of all files."""
    return parse_obj(read_lines(spark, path), longer_faces)


def parse_obj(lines: DataFrame, longer_faces: str = "first3") -> tuple[DataFrame, DataFrame]:
    """Parse ordered lines. Ids are 0-based and dense per file; other lines are ignored.

    ``longer_faces``: ``first3`` keeps the first three corners, ``drop`` drops the face.
    """
    toks = F.split(F.trim("line"), r"\s+")
    d = lines.withColumn("_tok", toks)
    kind, n = F.col("_tok")[0], F.size("_tok")
    enough = n == 4 if longer_faces == "drop" else n >= 4
    d = d.withColumns(
        {"_v": F.coalesce((kind == "v") & (n >= 4), F.lit(False)), "_f": F.coalesce((kind == "f") & enough, F.lit(False))}
    ).filter(F.col("_v") | F.col("_f"))
    d = running(
        d, ["file"], ORDER, F.col("block"),
        sums={"_vn": F.col("_v").cast("bigint"), "_fn": F.col("_f").cast("bigint")},
    ).withColumn("mesh_id", mesh_name(F.col("file")))
    tok = lambda i: F.get("_tok", F.lit(i))
    v = d.filter("_v").select(
        "mesh_id", (F.col("_vn") - 1).alias("vid"), *[tok(i + 1).try_cast("double").alias(a) for i, a in enumerate(AXES)]
    )
    f = d.filter("_f").select(
        "mesh_id", (F.col("_fn") - 1).alias("tri_id"),
        *[(F.split(tok(i + 1), "/")[0].try_cast("bigint") - 1).alias(f"v{i}") for i in range(3)],
    )
    return v, f


def obj_lines(vertices: DataFrame, faces: DataFrame, scale: float = 1.0, digits: int = 10) -> DataFrame:
    """``(mesh_id, kind, id, value)`` text rows, vertices before faces."""
    fmt = "v " + " ".join([f"%.{digits}f"] * 3)
    v = vertices.select(
        "mesh_id", F.lit(0).alias("kind"), F.col("vid").alias("id"),
        F.format_string(fmt, *[F.col(a) * float(scale) for a in AXES]).alias("value"),
    )
    f = faces.select(
        "mesh_id", F.lit(1).alias("kind"), F.col("tri_id").alias("id"),
        F.format_string("f %d %d %d", *[F.col(f"v{i}") + 1 for i in range(3)]).alias("value"),
    )
    return v.unionByName(f)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str, scale: float = 1.0, digits: int = 10) -> None:
    """One folder ``mesh_id=...`` per mesh; its part files, in name order, make one OBJ text.

    Rows are range-partitioned on (mesh, kind, id), so a huge mesh is written by many tasks.
    """
    rows = obj_lines(vertices, faces, scale, digits)
    rows.repartitionByRange("mesh_id", "kind", "id").sortWithinPartitions("mesh_id", "kind", "id").select(
        "mesh_id", "value"
    ).write.mode("overwrite").partitionBy("mesh_id").text(path)
