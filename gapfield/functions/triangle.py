"""Point, ray and box expressions against triangles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vec import V3, ratio, unit

# The ray direction of the inside/outside test (before normalization).
RAY_RAW = (1.0, 0.3713906763541037, 0.52999894000318)
RAY_EPS = 1e-12
_len = math.sqrt(sum(c * c for c in RAY_RAW))
RAY_DIR = tuple(c / _len for c in RAY_RAW)

# 32-bit FNV-1a and the normal quantization.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
NORMAL_STEPS = 4095.0
BRANCH_MASK = 0x3FFFFFFF


def face_normal(a: V3, b: V3, c: V3) -> V3:
    """Not normalized: twice the area long."""
    return (b - a).cross(c - a)


def edge_dots(df: DataFrame) -> DataFrame:
    """Add the per-triangle constants of the distance test: edges and their dots."""
    a, b, c = V3.of("a"), V3.of("b"), V3.of("c")
    ab, ac = b - a, c - a
    out = df.withColumns({**ab.named("u"), **ac.named("w")})
    u, w = V3.of("u"), V3.of("w")
    return out.withColumns({"uu": u.dot(u), "uw": u.dot(w), "ww": w.dot(w)})




def closest_weights(df: DataFrame, p: V3, prefix: str = "") -> DataFrame:
    """Add weights ``s``, ``t``: the closest point is ``a + s*(b-a) + t*(c-a)``.

    ``df`` holds :func:`edge_dots` columns. Three stacked projections keep every
    intermediate a single evaluated column. ``df`` gains ``s t`` and loses nothing else.
    """
    ap = p - V3.of("a")
    d = df.withColumns({"_d1": V3.of("u").dot(ap), "_d2": V3.of("w").dot(ap)})
    d1, d2 = F.col("_d1"), F.col("_d2")
    uu, uw, ww = F.col("uu"), F.col("uw"), F.col("ww")
    d = d.withColumns(
        {
            "_vc": uu * d2 - uw * d1,
            "_vb": d1 * ww - d2 * uw,
            "_e": (d2 - uw) - (d1 - uu),
            "_g": (d1 - uw) - (d2 - ww),
        }
    )
    # _vc, _vb are the unscaled barycentric weights of c and b; the weight of a is what is left.
    vc, vb, e, g = F.col("_vc"), F.col("_vb"), F.col("_e"), F.col("_g")
    den = uu * ww - uw * uw
    region = (
        F.when((d1 <= 0) & (d2 <= 0), 0)
        .when((d1 >= uu) & (d2 - uw <= d1 - uu), 1)
        .when((vc <= 0) & (d1 >= 0) & (d1 <= uu), 2)
        .when((d2 >= ww) & (d1 - uw <= d2 - ww), 3)
        .when((vb <= 0) & (d2 >= 0) & (d2 <= ww), 4)
        .when((den - vb - vc <= 0) & (e >= 0) & (g >= 0), 5)
        .otherwise(6)
    )
    d = d.withColumn("_reg", region)
    reg = F.col("_reg")
    edge = ratio(e, e + g, 0.0)
    s = (
        F.when(reg == 0, F.lit(0.0))
        .when(reg == 1, F.lit(1.0))
        .when(reg == 2, ratio(d1, uu, 0.0))
        .when((reg == 3) | (reg == 4), F.lit(0.0))
        .when(reg == 5, 1.0 - edge)
        .otherwise(ratio(vb, den, 0.0))
    )
    t = (
        F.when((reg == 0) | (reg == 1) | (reg == 2), F.lit(0.0))
        .when(reg == 3, F.lit(1.0))
        .when(reg == 4, ratio(d2, ww, 0.0))
        .when(reg == 5, edge)
        .otherwise(ratio(vc, den, 0.0))
    )
    d = d.withColumns({f"{prefix}s": s, f"{prefix}t": t})
    return d.drop("_d1", "_d2", "_vc", "_vb", "_e", "_g", "_reg")


def closest_point(df: DataFrame, p: V3, out: str = "c_") -> DataFrame:
    """Add the closest point ``{out}x..z`` and its squared distance ``d2``."""
    d = closest_weights(df, p)
    c = V3.of("a") + V3.of("u") * F.col("s") + V3.of("w") * F.col("t")
    d = d.withColumns(c.named(out)).drop("s", "t")
    return d.withColumn("d2", (p - V3.of(out)).norm2())


def barycentric(df: DataFrame, p: V3) -> DataFrame:
    """Add ``b0 b1 b2``; one third each when the triangle is degenerate."""
    q = p - V3.of("a")
    d = df.withColumns({"_p0": q.dot(V3.of("u")), "_p1": q.dot(V3.of("w"))})
    uu, uw, ww = F.col("uu"), F.col("uw"), F.col("ww")
    d = d.withColumn("_den", uu * ww - uw * uw)
    flat = F.abs(F.col("_den")) <= 1e-30
    third = F.lit(1.0 / 3.0)
    b1 = ratio(ww * F.col("_p0") - uw * F.col("_p1"), F.col("_den"))
    b2 = ratio(uu * F.col("_p1") - uw * F.col("_p0"), F.col("_den"))
    d = d.withColumns(
        {"b1": F.when(flat, third).otherwise(b1), "b2": F.when(flat, third).otherwise(b2)}
    )
    return d.withColumn("b0", 1.0 - F.col("b1") - F.col("b2")).drop("_p0", "_p1", "_den")


def branch_id(n: V3) -> Column:
    """FNV-1a over the three quantized components, 30 bits, plus 1.

    ``n`` must already be a unit vector (see :func:`vec.unit`).
    """
    full = F.lit(0xFFFFFFFF).cast("bigint")
    h = F.lit(FNV_OFFSET).cast("bigint")
    for c in n:
        q = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) * NORMAL_STEPS)
        q32 = q.cast("bigint").bitwiseAND(full)
        h = (h.bitwiseXOR(q32) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(full)
    return h.bitwiseAND(F.lit(BRANCH_MASK).cast("bigint")) + 1


def ray_hits(
    df: DataFrame, p: V3, a: V3, u: V3, w: V3, out: str = "hit", direction=RAY_DIR, eps: float = RAY_EPS
) -> DataFrame:
    """Add the boolean ``out``: does the ray from ``p`` hit the triangle ``a, a+u, a+w``?

    Stacked projections; count with ``count_if`` rather than filter on ``out``, because a
    filter is pushed below the projections and would repeat every shared term.
    """
    r = V3(*direction)
    names = df.columns
    d = df.withColumns({**r.cross(w).named("_pv"), **(p - a).named("_sv")})
    d = d.withColumns({"_det": u.dot(V3.of("_pv")), **V3.of("_sv").cross(u).named("_qv")})
    det = F.col("_det")
    d = d.withColumns(
        {
            "_bu": ratio(V3.of("_sv").dot(V3.of("_pv")), det),
            "_bv": ratio(r.dot(V3.of("_qv")), det),
            "_bt": ratio(w.dot(V3.of("_qv")), det),
        }
    )
    bu, bv = F.col("_bu"), F.col("_bv")
    ok = (
        (F.abs(det) >= eps) & (bu >= -eps) & (bu <= 1.0 + eps)
        & (bv >= -eps) & (bu + bv <= 1.0 + eps) & (F.col("_bt") > eps)
    )
    return d.select(*names, F.coalesce(ok, F.lit(False)).alias(out))


def ray_plane_axes(direction=RAY_DIR) -> tuple[tuple, tuple]:
    """Two unit vectors across the ray; projecting on them turns rays into 2-D points."""
    dx, dy, dz = direction
    n = math.hypot(dx, dy)
    e1 = (-dy / n, dx / n, 0.0)
    e2 = (
        dy * e1[2] - dz * e1[1],
        dz * e1[0] - dx * e1[2],
        dx * e1[1] - dy * e1[0],
    )
    return e1, e2


def box_dist2(p: V3, lo: V3, hi: V3) -> Column:
    """Squared distance from a point to a box, 0 inside."""
    zero = F.lit(0.0)
    d = V3(*(F.greatest(zero, l - c, c - h) for c, l, h in zip(p, lo, hi)))
    return d.norm2()


def box_ray(p: V3, lo: V3, hi: V3, direction=RAY_DIR) -> Column:
    """Slab test of the ray ``p + t*direction``, ``t >= 0``, against a box."""
    enter, leave = F.lit(0.0), F.lit(float("inf"))
    for c, l, h, r in zip(p, lo, hi, direction):
        if abs(r) < RAY_EPS:
            inside = (c >= l) & (c <= h)
            enter = F.when(inside, enter).otherwise(F.lit(float("inf")))
            continue
        t0, t1 = (l - c) / F.lit(r), (h - c) / F.lit(r)
        enter = F.greatest(enter, F.least(t0, t1))
        leave = F.least(leave, F.greatest(t0, t1))
    return enter <= leave


def box_overlaps(alo: V3, ahi: V3, blo: V3, bhi: V3) -> Column:
    out = F.lit(True)
    for al, ah, bl, bh in zip(alo, ahi, blo, bhi):
        out = out & (al <= bh) & (bl <= ah)
    return out


__all__ = [
    "RAY_DIR", "barycentric", "box_dist2", "box_overlaps", "box_ray",
    "branch_id", "closest_point", "closest_weights", "edge_dots", "face_normal",
    "ray_hits", "ray_plane_axes", "unit",
]
