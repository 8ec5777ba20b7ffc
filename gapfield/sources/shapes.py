"""Parametric meshes and surface points, generated by index arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Density presets (segments around, across, up).
CYLINDER_PRESETS = {
    "coarse": (12, 1, 2),
    "medium": (20, 2, 3),
    "fine": (27, 2, 4),
    "dense": (40, 3, 6),
    "very_dense": (60, 4, 10),
}


def _quads(cells: DataFrame, corner, flip: Column) -> DataFrame:
    """Two triangles per cell; ``corner(du, dv)`` is the vertex id expression of a cell corner."""
    a, b, c, d = corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)
    tri = lambda p, q, r, s: F.struct(F.lit(s).alias("s"), p.alias("v0"), q.alias("v1"), r.alias("v2"))
    two = F.when(flip, F.array(tri(a, c, b, 0), tri(b, c, d, 1))).otherwise(F.array(tri(a, b, c, 0), tri(b, d, c, 1)))
    return cells.withColumn("_t", F.explode(two)).select(
        (F.col("id") * 2 + F.col("_t.s")).alias("tri_id"), "_t.v0", "_t.v1", "_t.v2"
    )


def cube_mesh(spark: SparkSession, half_width: float = 2.0, max_edge: float = 0.2, mesh_id: str = "cube"):
    """Subdivided cube whose top is z = 0: ``vertices`` and ``faces``."""
    n = max(math.ceil(2 * half_width / (max_edge / math.sqrt(2.0))), 2)
    m = n + 1
    v = spark.range(6 * m * m)
    side, r = F.floor(F.col("id") / (m * m)), F.pmod("id", F.lit(m * m))
    v = v.withColumns({"_side": side, "_i": F.floor(r / m), "_j": F.pmod(r, F.lit(m))})
    axis = F.floor(F.col("_side") / 2)
    w = F.when(F.pmod("_side", F.lit(2)) == 1, half_width).otherwise(-half_width)
    u = F.col("_i") * (2.0 * half_width / n) - half_width
    t = F.col("_j") * (2.0 * half_width / n) - half_width
    v = v.select(
        F.lit(mesh_id).alias("mesh_id"), F.col("id").alias("vid"),
        F.when(axis == 0, w).otherwise(u).alias("x"),
        F.when(axis == 0, u).when(axis == 1, w).otherwise(t).alias("y"),
        (F.when(axis == 2, w).otherwise(t) - half_width).alias("z"),
    )
    c = spark.range(6 * n * n)
    side, r = F.floor(F.col("id") / (n * n)), F.pmod("id", F.lit(n * n))
    c = c.withColumns({"_side": side, "_i": F.floor(r / n), "_j": F.pmod(r, F.lit(n))})

    def corner(du, dv):
        return F.col("_side") * (m * m) + (F.col("_i") + du) * m + F.col("_j") + dv

    # corner(0,1) is one step along v, corner(1,0) one along u
    f = _quads(c, corner, F.pmod("_side", F.lit(2)) == 1)
    return v, f.select(F.lit(mesh_id).alias("mesh_id"), "*")


def hollow_cylinder_mesh(
    spark: SparkSession, ri: float = 0.4, ro: float = 0.6, height: float = 0.5,
    n_az: int = 27, n_rad: int = 2, n_vert: int = 4, mesh_id: str = "hollow_cylinder",
):
    """Two walls and two annular ends, each with its own vertices."""
    wall, ring = (n_vert + 1) * n_az, n_az * (n_rad + 1)
    step = 2.0 * math.pi / n_az
    # walls: rows of n_az vertices going up; ends: n_az spokes of n_rad + 1 vertices
    v = spark.range(2 * wall + 2 * ring)
    i = F.col("id")
    on_wall = i < 2 * wall
    lw, lr = F.pmod(i, F.lit(wall)), F.pmod(i - 2 * wall, F.lit(ring))
    r = F.when(on_wall, F.when(i < wall, ri).otherwise(ro)).otherwise(F.pmod(lr, F.lit(n_rad + 1)) * ((ro - ri) / n_rad) + ri)
    th = F.when(on_wall, F.pmod(lw, F.lit(n_az))).otherwise(F.floor(lr / (n_rad + 1))) * step
    z = F.when(on_wall, F.floor(lw / n_az) * (height / n_vert)).otherwise(F.when(i < 2 * wall + ring, 0.0).otherwise(height))
    v = v.select(
        F.lit(mesh_id).alias("mesh_id"), i.alias("vid"), (r * F.cos(th)).alias("x"), (r * F.sin(th)).alias("y"), z.cast("double").alias("z")
    )
    cw, cr = n_vert * n_az, n_az * n_rad
    c = spark.range(2 * cw + 2 * cr)
    on_wall = F.col("id") < 2 * cw
    k = F.when(on_wall, F.floor(F.col("id") / cw)).otherwise(F.floor((F.col("id") - 2 * cw) / cr))
    c = c.withColumns({"_wall": on_wall, "_k": k})
    l = F.when(F.col("_wall"), F.pmod("id", F.lit(cw))).otherwise(F.pmod(F.col("id") - 2 * cw, F.lit(cr)))
    c = c.withColumn("_l", l)

    def corner(du, dv):
        row, az = F.floor(F.col("_l") / n_az), F.pmod("_l", F.lit(n_az))
        w = F.col("_k") * wall + (row + du) * n_az + F.pmod(az + dv, F.lit(n_az))
        spoke, out = F.floor(F.col("_l") / n_rad), F.pmod("_l", F.lit(n_rad))
        e = 2 * wall + F.col("_k") * ring + F.pmod(spoke + du, F.lit(n_az)) * (n_rad + 1) + out + dv
        return F.when(F.col("_wall"), w).otherwise(e).cast("bigint")

    f = _quads(c, corner, F.col("_k") == 0)
    return v, f.select(F.lit(mesh_id).alias("mesh_id"), "*")


def annular_sectors(df: DataFrame, ri: Column, ro: Column, n_rad: int, n_az: int) -> DataFrame:
    """Expand every row into the sector midpoints of an annulus: ``qid x y z w``.

    The weight is the exact sector area.
    """
    dth = 2.0 * math.pi / n_az
    d = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n_rad - 1))))
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n_az - 1))))
    dr = (ro - ri) / F.lit(float(n_rad))
    d = d.withColumns({"_a": ri + F.col("_i") * dr, "_b": ri + (F.col("_i") + 1) * dr, "_th": (F.col("_j") + 0.5) * dth})
    rc = (F.col("_a") + F.col("_b")) * 0.5
    return d.withColumns(
        {
            "qid": (F.col("_i") * n_az + F.col("_j")).cast("bigint"),
            "x": rc * F.cos("_th"), "y": rc * F.sin("_th"), "z": F.lit(0.0),
            "w": (F.col("_b") * F.col("_b") - F.col("_a") * F.col("_a")) * (0.5 * dth),
        }
    ).drop("_i", "_j", "_a", "_b", "_th")


def annular_points(spark: SparkSession, ri: float, ro: float, n_rad: int = 20, n_az: int = 64, z: float = 0.0) -> DataFrame:
    d = annular_sectors(spark.range(1).drop("id"), F.lit(float(ri)), F.lit(float(ro)), n_rad, n_az)
    return d.withColumn("z", F.lit(float(z)))


def wall_points(spark: SparkSession, radius: float, half_height: float, n_az: int, n_z: int) -> DataFrame:
    """Midpoints of a cylinder wall with exact patch areas."""
    dth, dz = 2.0 * math.pi / n_az, 2.0 * half_height / n_z
    d = spark.range(n_z * n_az)
    k, j = F.floor(F.col("id") / n_az), F.pmod("id", F.lit(n_az))
    th = (j + 0.5) * dth
    return d.select(
        F.col("id").alias("qid"), (F.cos(th) * radius).alias("x"), (F.sin(th) * radius).alias("y"),
        ((k + 0.5) * dz - half_height).alias("z"), F.lit(radius * dth * dz).alias("w"),
    )


def ring_points(spark: SparkSession, ri: float, ro: float, half_height: float, n_rad: int, n_az: int, n_z: int) -> DataFrame:
    """Bottom annulus, inner and outer wall in one point set with running ids."""
    a = annular_points(spark, ri, ro, n_rad, n_az, -half_height)
    base, wall = n_rad * n_az, n_z * n_az
    inner = wall_points(spark, ri, half_height, n_az, n_z).withColumn("qid", F.col("qid") + base)
    outer = wall_points(spark, ro, half_height, n_az, n_z).withColumn("qid", F.col("qid") + base + wall)
    return a.unionByName(inner).unionByName(outer)


def square_points(spark: SparkSession, half: float, n: int, z: float = 0.0) -> DataFrame:
    """Midpoints of an n x n square patch."""
    h = 2.0 * half / n
    d = spark.range(n * n)
    i, j = F.floor(F.col("id") / n), F.pmod("id", F.lit(n))
    return d.select(
        F.col("id").alias("qid"), ((i + 0.5) * h - half).alias("x"), ((j + 0.5) * h - half).alias("y"),
        F.lit(float(z)).alias("z"), F.lit(h * h).alias("w"),
    )
