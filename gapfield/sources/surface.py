"""Corner-normal surface text: bulk read with a defect table instead of exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_comment
from ..functions.triangle import face_normal
from ..functions.vec import AXES, M3, V3, ratio
from ..operators.ordered import running
from ..session import cut_lineage
from .lines import ORDER, read_lines

# The header is a producer word ending in this suffix, followed by the version.
HEADER = r"^\w+_CONTACT_AWARE_SURFACE 1\b"
TOKENS = ("surface", "end", "transform", "vertices", "triangles", "v", "tri")


def _inverse_transpose(m: M3) -> tuple[M3, object]:
    """Cofactor matrix over the determinant, and the determinant."""
    r0, r1, r2 = m.row(0), m.row(1), m.row(2)
    det = r0.dot(r1.cross(r2))
    rows = [r1.cross(r2), r2.cross(r0), r0.cross(r1)]
    return M3([[ratio(c, det) for c in r] for r in rows]), det


def read_surfaces(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_surfaces(read_lines(spark, path))


def parse_surfaces(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``vertices(file, surface_no, surface, vid, x, y, z)``, ``faces`` with corner normals
    ``n0 n1 n2`` and ``defects(file, line_no, kind, detail)``.

    Vertex ids are dense per file. Points are moved by the surface's 4x4 transform, normals by
    its inverse transpose. A face or vertex with a defect is left out and listed.
    """
    d = lines.withColumn("_txt", strip_comment(F.col("line")))
    d = d.withColumn("_tok", F.split("_txt", " ")).withColumn("_t", F.col("_tok")[0])
    blank = F.col("_txt") == ""
    nums = F.transform(F.slice("_tok", 2, F.size("_tok")), lambda s: s.try_cast("double"))
    d = d.withColumns({"_num": nums, "_blank": blank})
    d = running(
        d, ["file"], ORDER, F.col("block"),
        sums={
            "line_no": F.lit(1).cast("bigint"),
            "surface_no": (F.col("_t") == "surface").cast("bigint"),
            "_filled": (~F.col("_blank")).cast("bigint"),
            "_vn": (F.col("_t") == "v").cast("bigint"),
            "_fn": (F.col("_t") == "tri").cast("bigint"),
        },
        last={
            "_state": F.when(F.col("_t").isin("surface", "end"), F.struct(F.col("_t").alias("t"), F.get("_tok", F.lit(1)).alias("name"))),
            "_tm": F.when(F.col("_t").isin("surface", "transform"), F.struct(F.col("_t").alias("t"), F.col("_num").alias("m"))),
        },
    ).filter(~F.col("_blank"))
    # some twenty branches read the parsed lines: they are stored once
    d = cut_lineage(d)
    header = F.col("_filled") == 1
    active = F.coalesce(F.col("_state.t") == "surface", F.lit(False))

    def defect(df, kind, detail=None, line="line_no"):
        text = F.lit(None).cast("string") if detail is None else detail.cast("string")
        at = F.lit(None).cast("bigint") if line is None else F.col(line)
        return df.select("file", at.alias("line_no"), F.lit(kind).alias("kind"), text.alias("detail"))

    bad = [defect(d.filter(header & ~F.col("_txt").rlike(HEADER)), "bad_header", F.col("_txt"))]
    body = d.filter(~header)
    bad.append(defect(body.filter(~F.col("_t").isin(*TOKENS)), "unknown_token", F.col("_t")))
    bad.append(
        defect(body.filter(~active & F.col("_t").isin("transform", "vertices", "triangles", "v", "tri")), "outside_surface", F.col("_t"))
    )
    bad.append(defect(body.filter((F.col("_t") == "surface") & F.get("_tok", F.lit(1)).isNull()), "unnamed_surface"))
    inside = body.filter(active)

    def num(i):
        return F.get("_num", F.lit(i))

    moved = F.col("_tm.t") == "transform"
    full = F.size(F.filter("_tm.m", lambda x: x.isNotNull())) >= 16

    def tm(i, eye):
        return F.when(moved & full, F.get("_tm.m", F.lit(i))).otherwise(F.lit(float(eye)))

    inside = inside.withColumns({f"m{r}{c}": tm(4 * r + c, r == c) for r in range(4) for c in range(4)})
    lin = M3.of("m")
    inv_t, det = _inverse_transpose(lin)
    is_tm = F.col("_t") == "transform"
    bad.append(defect(inside.filter(is_tm & ~full), "bad_transform", F.col("_txt")))
    bad.append(defect(inside.filter(is_tm & full & (F.abs(det) <= 1e-15)), "singular_transform", F.col("_txt")))

    name = F.col("_state.name")
    key = ["file", "surface_no"]
    v = inside.filter(F.col("_t") == "v")
    ok_v = num(0).isNotNull() & num(1).isNotNull() & num(2).isNotNull() & num(3).isNotNull()
    bad.append(defect(v.filter(~ok_v), "bad_vertex", F.col("_txt")))
    p = V3(num(1), num(2), num(3))
    q = lin @ p + V3(F.col("m03"), F.col("m13"), F.col("m23"))
    hw = F.col("m30") * p.x + F.col("m31") * p.y + F.col("m32") * p.z + F.col("m33")
    v = v.filter(ok_v).select(
        *key, "line_no", name.alias("surface"), num(0).cast("bigint").alias("local_id"),
        (F.col("_vn") - 1).alias("vid"), *q.cols("_q"), hw.alias("_w"),
    )
    w = F.when(F.abs("_w") > 1e-15, F.col("_w")).otherwise(1.0)
    v = v.withColumns({a: ratio(F.col(f"_q{a}"), w) for a in AXES}).drop("_qx", "_qy", "_qz", "_w")
    dup = v.groupBy(*key, "local_id").agg(F.count(F.lit(1)).alias("_n"), F.max("line_no").alias("line_no")).filter("_n > 1")
    bad.append(defect(dup, "duplicate_vertex_id", F.col("local_id")))
    first = v.groupBy(*key, "local_id").agg(F.min_by(F.struct("vid", *AXES), "line_no").alias("_v"))

    t = inside.filter(F.col("_t") == "tri")
    ok_t = F.size(F.filter("_num", lambda x: x.isNotNull())) >= 13
    bad.append(defect(t.filter(~ok_t), "bad_triangle", F.col("_txt")))
    t = t.filter(ok_t).withColumns(inv_t.named("i"))
    corner = F.array(
        *[
            F.struct(
                F.lit(c).alias("c"), num(1 + c).cast("bigint").alias("local_id"),
                *[x.alias(a) for a, x in zip(AXES, M3.of("i") @ V3(num(4 + 3 * c), num(5 + 3 * c), num(6 + 3 * c)))],
            )
            for c in range(3)
        ]
    )
    t = t.select(*key, "line_no", name.alias("surface"), (F.col("_fn") - 1).alias("tri_id"), F.explode(corner).alias("_c"))
    t = t.select(*key, "line_no", "surface", "tri_id", F.col("_c.c").alias("c"), F.col("_c.local_id").alias("local_id"),
                 *[F.col(f"_c.{a}").alias(f"n{a}") for a in AXES])
    t = t.withColumn("_nl", V3.of("n").norm())
    zero = F.coalesce((F.col("_nl") <= 1e-15) | F.isnan("_nl") | (F.col("_nl") == float("inf")), F.lit(True))
    bad.append(defect(t.filter(zero), "zero_normal", F.col("c")))
    j = t.join(first, [*key, "local_id"], "left")
    bad.append(defect(j.filter(F.col("_v").isNull()), "unknown_vertex", F.col("local_id")))
    n = V3.of("n").over(F.col("_nl"))
    item = F.struct(F.col("_v.vid").alias("vid"), F.struct(*[F.col(f"_v.{a}").alias(a) for a in AXES]).alias("p"), n.struct().alias("n"))
    good = F.col("_v").isNotNull() & ~zero
    g = j.groupBy(*key, "line_no", "surface", "tri_id").agg(
        F.count_if(good).alias("_ok"), *[F.max(F.when((F.col("c") == c) & good, item)).alias(f"_k{c}") for c in range(3)]
    ).filter(F.col("_ok") == 3)
    area2 = face_normal(*(V3.field(F.col(f"_k{c}.p")) for c in range(3))).norm()
    g = g.withColumn("_flat", area2 <= 1e-15)
    bad.append(defect(g.filter("_flat"), "degenerate_triangle"))
    faces = g.filter(~F.col("_flat")).select(
        *key, "surface", "tri_id", *[F.col(f"_k{c}.vid").alias(f"v{c}") for c in range(3)],
        *[F.col(f"_k{c}.n").alias(f"n{c}") for c in range(3)],
    )

    counts = inside.groupBy(*key).agg(
        F.max(F.when(F.col("_t") == "vertices", num(0))).alias("vx"),
        F.max(F.when(F.col("_t") == "triangles", num(0))).alias("tx"),
        F.count_if(F.col("_t") == "v").alias("vn"), F.count_if(F.col("_t") == "tri").alias("tn"),
        F.min("line_no").alias("line_no"),
    )
    for x, seen, what in (("vx", "vn", "vertex"), ("tx", "tn", "triangle")):
        bad.append(defect(counts.filter(F.col(x).isNull()), f"missing_{what}_count"))
        bad.append(defect(counts.filter(F.col(x) != F.col(seen)), f"{what}_count_mismatch", F.col(seen)))
    defects = bad[0]
    for b in bad[1:]:
        defects = defects.unionByName(b)
    return v.select(*key, "surface", "vid", *AXES), faces, defects
