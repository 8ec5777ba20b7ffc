"""Mesh tables: corners, attributes, defects, bounds and surface points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.triangle import face_normal
from ..functions.vec import AXES, M3, V3, unit

CORNERS = ("a", "b", "c")


def join_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the coordinates of their three vertices; a face with a dangling id is dropped.

    One join over exploded corners and one aggregation, instead of three joins.
    """
    corner = F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid")
    ref = faces.select("mesh_id", "tri_id", corner)
    hit = ref.join(vertices.select("mesh_id", "vid", *AXES), ["mesh_id", "vid"])
    aggs = [
        F.max(F.when(F.col("corner") == n, F.col(a))).alias(f"{c}{a}")
        for n, c in enumerate(CORNERS)
        for a in AXES
    ]
    out = hit.groupBy("mesh_id", "tri_id").agg(F.count(F.lit(1)).alias("_n"), *aggs)
    return out.filter(F.col("_n") == 3).drop("_n")


def dangling(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Corner references to a vertex id that does not exist."""
    corner = F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid")
    return faces.select("mesh_id", "tri_id", corner).join(
        vertices.select("mesh_id", "vid"), ["mesh_id", "vid"], "left_anti"
    )


def with_attributes(tris: DataFrame) -> DataFrame:
    """Add unit normal, area, centroid and box to rows holding ``ax..cz``."""
    a, b, c = (V3.of(p) for p in CORNERS)
    d = tris.withColumns(face_normal(a, b, c).named("_f"))
    d = d.withColumn("_fl", V3.of("_f").norm())
    n = unit(V3.of("_f"), F.col("_fl"), V3(0.0, 0.0, 1.0))
    lo = V3(*(F.least(*t) for t in zip(a, b, c)))
    hi = V3(*(F.greatest(*t) for t in zip(a, b, c)))
    third = (a + b + c) * F.lit(1.0 / 3.0)
    cols = {**n.named("n"), "area": F.col("_fl") * 0.5, **third.named("g"), **lo.named("bmin"), **hi.named("bmax")}
    return d.withColumns(cols).drop("_fx", "_fy", "_fz", "_fl")


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangle attributes: corners, unit normal, area, centroid and box."""
    return with_attributes(join_corners(faces, vertices))


def surface_points(tris: DataFrame, offset: V3 | None = None) -> DataFrame:
    """One point per triangle: centroid and area; ``offset`` moves it to the body frame."""
    g = V3.of("g")
    p = g if offset is None else g + offset
    return tris.select(
        "mesh_id", F.col("tri_id").alias("qid"), *p.cols(), F.col("area").alias("w"),
        *V3.of("n").cols("tn"), "tri_id",
    )


def face_class(nz: Column, tol: float = 0.01) -> Column:
    return F.when(nz < -(1.0 - tol), "bottom").when(nz > 1.0 - tol, "top").otherwise("wall")


def mesh_defects(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per defect of a vertex/face pair of tables: kind, ids, detail.

    Kinds: ``bad_vertex_reference``, ``duplicate_vertex_id``, ``degenerate_triangle``,
    ``non_finite_vertex``.
    """

    def rows(df, kind, tri, vid):
        return df.select("mesh_id", F.lit(kind).alias("kind"), tri.cast("bigint").alias("tri_id"), vid.cast("bigint").alias("vid"))

    none = F.lit(None)
    bad = rows(dangling(faces, vertices), "bad_vertex_reference", F.col("tri_id"), F.col("vid"))
    dup = rows(
        vertices.groupBy("mesh_id", "vid").count().filter("count > 1"),
        "duplicate_vertex_id", none, F.col("vid"),
    )
    broken = F.lit(False)
    for a in AXES:
        c = F.col(a)
        broken = broken | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    nonfinite = rows(vertices.filter(broken), "non_finite_vertex", none, F.col("vid"))
    one = vertices.groupBy("mesh_id", "vid").agg(*[F.min(a).alias(a) for a in AXES])
    t = join_corners(faces, one)
    area2 = face_normal(*(V3.of(p) for p in CORNERS)).norm()
    flat = rows(t.filter(area2 <= 1e-15), "degenerate_triangle", F.col("tri_id"), none)
    return bad.unionByName(dup).unionByName(flat).unionByName(nonfinite)


def bounds(vertices: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Coordinate range per key."""
    return vertices.groupBy(*keys).agg(
        *[F.min(a).alias(f"lo{a}") for a in AXES], *[F.max(a).alias(f"hi{a}") for a in AXES]
    )


def grid_spec(
    vertices: DataFrame,
    *,
    padding: float = 0.1,
    target: int | Column = 128,
    max_res: int = 512,
    voxel_size: float | None = None,
    keys: Sequence[str] = ("mesh_id",),
) -> DataFrame:
    """Padded and snapped grid per mesh. The upper corner follows from the snapped dimensions."""
    lo, hi = V3.of("lo"), V3.of("hi")
    d = bounds(vertices, keys)
    d = d.withColumn("_pad", (hi - lo).norm() * padding)
    pad = F.col("_pad")
    d = d.withColumns(
        {**{f"bmin{a}": F.col(f"lo{a}") - pad for a in AXES}, **{f"_len{a}": F.col(f"hi{a}") - F.col(f"lo{a}") + 2 * pad for a in AXES}}
    )
    longest = F.greatest(*[F.col(f"_len{a}") for a in AXES])
    tgt = target if isinstance(target, Column) else F.lit(target)
    h = longest / tgt if voxel_size is None else F.lit(float(voxel_size))
    d = d.withColumn("_h", h)
    dims = {
        f"dim{a}": grid.snap_resolution(F.ceil(F.col(f"_len{a}") / F.col("_h")), max_res).cast("int")
        for a in AXES
    }
    d = d.withColumns({**dims, **{f"vox{a}": F.col("_h") for a in AXES}})
    d = d.withColumns({f"bmax{a}": F.col(f"bmin{a}") + F.col(f"dim{a}") * F.col(f"vox{a}") for a in AXES})
    drop = ["_pad", "_h", *[f"_len{a}" for a in AXES], *[f"lo{a}" for a in AXES], *[f"hi{a}" for a in AXES]]
    return d.drop(*drop)


def max_edge(tris: DataFrame, limit: float) -> DataFrame:
    """Longest edge per mesh and whether it keeps the limit."""
    a, b, c = (V3.of(p) for p in CORNERS)
    edge = F.greatest((b - a).norm(), (c - b).norm(), (a - c).norm())
    return (
        tris.groupBy("mesh_id")
        .agg(F.max(edge).alias("max_edge"))
        .withColumn("within_limit", F.col("max_edge") <= limit)
    )


def point_boxes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centre and half extents of a point set."""
    b = bounds(points, keys)
    lo, hi = V3.of("lo"), V3.of("hi")
    return b.select(*keys, *((lo + hi) * 0.5).cols("c"), *((hi - lo) * 0.5).cols("h"))


def rotated_box(rot: M3, r: V3) -> tuple[V3, V3]:
    """World centre and half extents of the box ``c``/``h`` under a pose: ``abs(R) * half``."""
    return r + (rot @ V3.of("c")), rot.abs() @ V3.of("h")


def merge_surfaces(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surfaces of one file become one mesh with file-wide vertex and triangle ids.

    Inputs carry ``file``, ``surface_no`` and ids that are dense per surface; offsets come
    from one row per surface, so no file is numbered in a single task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("surface_no").rowsBetween(Window.unboundedPreceding, -1)

    def offsets(df, name):
        n = df.groupBy("file", "surface_no").agg(F.count(F.lit(1)).alias("_n"))
        return n.select("file", "surface_no", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(name))

    vo, fo = offsets(vertices, "_vo"), offsets(faces, "_fo")
    v = vertices.join(vo, ["file", "surface_no"]).select(
        F.col("file").alias("mesh_id"), (F.col("vid") + F.col("_vo")).alias("vid"), *AXES
    )
    ids = [(F.col(c) + F.col("_vo")).alias(c) for c in ("v0", "v1", "v2")]
    extra = [c for c in faces.columns if c not in ("file", "surface_no", "mesh_id", "tri_id", "v0", "v1", "v2")]
    f = (
        faces.join(vo, ["file", "surface_no"])
        .join(fo, ["file", "surface_no"])
        .select(F.col("file").alias("mesh_id"), (F.col("tri_id") + F.col("_fo")).alias("tri_id"), *ids, *extra)
    )
    return v, f


