"""Meshes, fields, points, contacts and signals derived from the driver tables.

Each function here has a twin in :mod:`checks.sql` that states the same rows for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfield.functions.vec import AXES, V3
from gapfield.operators import mesh
from gapfield.session import grown, spread

# irrational multipliers that scatter a price into three coordinates
GOLD, ROOT2, ROOT3 = 0.6180339887, 0.4142135623, 0.7320508075
START_US = 1704067200000000
CORNERS = [f"{c}{a}" for c in "abc" for a in AXES]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frac(c: Column | str, m: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c * m - F.floor(c * m)


def scatter(c: str, width: float, low: float) -> dict[str, Column]:
    return {a: frac(c, m) * width + low for a, m in zip(AXES, (GOLD, ROOT2, ROOT3))}


def tris(spark, sf) -> DataFrame:
    """One triangle per embedding, one mesh per label, with attributes."""
    e = load(spark, sf, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(CORNERS)]
    raw = e.select(F.col("label").cast("string").alias("mesh_id"), F.col("vec_id").alias("tri_id"), *cols)
    return mesh.with_attributes(raw)


def vertices_faces(spark, sf, by_label: bool = True) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf, "embeddings").select(
        (F.col("label").cast("string") if by_label else F.lit("all")).alias("mesh_id"), "vec_id",
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(CORNERS)],
    )
    corner = F.array(*[F.struct(F.lit(n).alias("n"), *[F.col(f"{c}{a}").alias(a) for a in AXES]) for n, c in enumerate("abc")])
    v = e.select("mesh_id", "vec_id", F.explode(corner).alias("c")).select(
        "mesh_id", (F.col("vec_id") * 3 + F.col("c.n")).alias("vid"), *[F.col(f"c.{a}").alias(a) for a in AXES]
    )
    f = e.select("mesh_id", F.col("vec_id").alias("tri_id"), *[(F.col("vec_id") * 3 + n).alias(f"v{n}") for n in range(3)])
    return v, f


def mesh_points(spark, sf) -> DataFrame:
    """One query point per order, each asked of one of the ten meshes."""
    o = load(spark, sf, "orders")
    return o.select(
        F.pmod("o_orderkey", F.lit(10)).cast("string").alias("mesh_id"), F.col("o_orderkey").alias("qid"),
        *[c.alias(a) for a, c in scatter("o_totalprice", 0.8, -0.4).items()],
    )


# ---- one sphere field per supplier -------------------------------------------------------


def sphere_fields(spark, sf) -> DataFrame:
    s = load(spark, sf, "supplier")
    one = {f"{q}{a}": F.lit(v) for q, v in (("bmin", -1.0), ("bmax", 1.0), ("vox", 0.25)) for a in AXES}
    d = s.select(
        F.col("s_suppkey").alias("field_id"), (frac("s_acctbal", GOLD) * 0.4 + 0.3).alias("radius"),
        (frac("s_acctbal", ROOT2) * 0.2 - 0.1).alias("cx"), (frac("s_acctbal", ROOT3) * 0.2 - 0.1).alias("cy"),
        F.when(F.col("s_nationkey") % 2 == 0, 3).otherwise(0).alias("stride"),
    )
    return d.withColumns({**one, **{f"dim{a}": F.lit(8) for a in AXES}, "cz": F.lit(0.05), "block_dim": F.lit(4)})


def sphere_voxels(spark, sf, hess: bool = True) -> DataFrame:
    """All 512 voxels of every sphere field, from the closed form."""
    d = spread(sphere_fields(spark, sf), "field_id")
    for i in "ijk":
        d = d.withColumn(i, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    p = {f"_d{a}": (F.col(i) + 0.5) * 0.25 - 1.0 - F.col(f"c{a}") for a, i in zip(AXES, "ijk")}
    d = d.withColumns(p).withColumn("_l", V3.of("_d").norm())
    d = d.withColumns({"phi": F.col("_l") - F.col("radius"), **{f"n{a}": F.col(f"_d{a}") / F.col("_l") for a in AXES}})
    d = d.withColumns({b: F.floor(F.col(i) / 4).cast("bigint") for b, i in zip(("bi", "bj", "bk"), "ijk")})
    out = ["field_id", "i", "j", "k", "bi", "bj", "bk", "phi", "nx", "ny", "nz"]
    if hess:
        h = {}
        for x, a in enumerate(AXES):
            for b in AXES[x:]:
                h[f"h{a}{b}"] = (F.lit(1.0 if a == b else 0.0) - F.col(f"n{a}") * F.col(f"n{b}")) / F.col("_l")
        d = d.withColumns(h)
        out += list(h)
    return d.select(*out)


def narrow_band(voxels: DataFrame) -> DataFrame:
    """The stored voxels of a narrow band: blocks with a sample within 0.1, values as float."""
    near = voxels.groupBy("field_id", "bi", "bj", "bk").agg(F.min(F.abs("phi")).alias("m")).filter("m <= 0.1")
    v = voxels.join(grown(near.drop("m")), ["field_id", "bi", "bj", "bk"], "left_semi")
    return v.withColumns({c: F.col(c).cast("float") for c in ("phi", "nx", "ny", "nz")})


def sphere_candidates(spark, sf) -> DataFrame:
    """Three candidates per voxel of the fields that have candidates, none where (i+j+k) mod 3 = 0."""
    v = sphere_voxels(spark, sf, hess=False).join(sphere_fields(spark, sf).filter("stride > 0").select("field_id"), "field_id", "left_semi")
    v = v.filter((F.col("i") + F.col("j") + F.col("k")) % 3 != 0)
    v = v.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(2))))
    r = F.col("rank").cast("double")
    return v.select(
        "field_id", "i", "j", "k", "rank", (F.col("phi") - r * 0.05).alias("phi"),
        (F.col("nx") + r * 0.1 * F.col("ny")).alias("nx"), (F.col("ny") + r * 0.1 * F.col("nz")).alias("ny"),
        (F.col("nz") + r * 0.1 * F.col("nx")).alias("nz"), (F.col("rank") + 1).cast("bigint").alias("branch_id"),
    )


def sphere_points(spark, sf) -> DataFrame:
    """One point per order, asked of the field of the order's lowest supplier; -1, an unknown field, without items."""
    f = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("field_id"))
    o = load(spark, sf, "orders").join(grown(f), "o_orderkey", "left")
    return o.select(F.coalesce("field_id", F.lit(-1)).cast("bigint").alias("field_id"), F.col("o_orderkey").alias("qid"), *[c.alias(a) for a, c in scatter("o_totalprice", 2.1, -1.05).items()])


def repeated_points(spark, sf) -> DataFrame:
    """One point per line item; ids repeat, so a point of a field is asked many times under one id."""
    l = load(spark, sf, "lineitem")
    xyz = [c.alias(a) for a, c in scatter("l_extendedprice", 2.1, -1.05).items()]
    return l.select(F.col("l_suppkey").alias("field_id"), (F.col("l_orderkey") % 50).alias("qid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asked"), *xyz).distinct()


# ---- contacts ------------------------------------------------------------------------------


def contact_rows(spark, sf) -> DataFrame:
    """One contact point row per line item: run = return flag, time = line number, pair = supplier."""
    l = load(spark, sf, "lineitem")
    sup = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), *[c.alias(f"ra{a}") for a, c in scatter("s_acctbal", 2.0, -1.0).items()],
        *[c.alias(f"rb{a}") for a, c in zip(AXES, list(scatter("s_acctbal", 1.0, 0.5).values())[::-1])],
    )
    d = l.join(sup, "l_suppkey")
    g = scatter("l_extendedprice", 2.0, -1.0)
    p = {f"p{a}": c for a, c in zip(AXES, list(scatter("l_extendedprice", 1.0, 0.0).values())[::-1])}
    vel = {f"{q}{a}": F.col("l_tax") * (n + 1) - 0.1 * m for m, q in enumerate(("va", "oa", "vb", "ob")) for n, a in enumerate(AXES)}
    d = d.select(
        F.col("l_returnflag").alias("run_id"), F.col("l_linenumber").cast("double").alias("t"), F.col("l_suppkey").alias("cp_id"),
        F.col("l_orderkey").alias("qid"), (F.col("l_discount") - 0.05).alias("gap"), F.col("l_quantity").alias("w"),
        *[c.alias(f"g{a}") for a, c in g.items()], *[c.alias(n) for n, c in p.items()],
        *[f"{b}{a}" for b in ("ra", "rb") for a in AXES], *[c.alias(n) for n, c in vel.items()],
        (F.col("l_linestatus") == "O").alias("valid"),
        F.lit(1000.0).alias("k"), F.lit(0.3).alias("mu"), (F.lit(1.0) + F.col("l_linenumber") % 2).alias("order"),
        F.lit(10.0).alias("damping"), F.lit(1e-4).alias("reg"), F.lit(0.01).alias("eps"),
    )
    return d


def bodies(spark, sf) -> DataFrame:
    """Bodies are suppliers (side A) and their nations (side B, ids from 1,000,000); nation 0 is fixed."""
    a = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("body_id"), F.col("s_acctbal").alias("mass"), F.lit(False).alias("fixed"))
    b = load(spark, sf, "nation").select((F.col("n_nationkey") + 1000000).cast("bigint").alias("body_id"), F.lit(1.0).alias("mass"), (F.col("n_nationkey") == 0).alias("fixed"))
    return a.unionByName(b)


def contact_pairs(spark, sf) -> DataFrame:
    return load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("cp_id"), F.col("s_suppkey").alias("body_a"), (F.col("s_nationkey") + 1000000).cast("bigint").alias("body_b")
    )


# ---- signals -------------------------------------------------------------------------------


def seconds(spark) -> Column:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return us / F.lit(1e6)


def events(spark, sf) -> DataFrame:
    return load(spark, sf, "events").select("event_id", "user_id", "event_type", seconds(spark).alias("t"), "value")


def measures(spark, sf) -> DataFrame:
    """A gap series per user and event type: 20 is the surface, lower values penetrate."""
    gap = F.col("value") - 20.0
    return events(spark, sf).select(
        "user_id", "event_type", "t", gap.alias("gap"), F.greatest(F.lit(0.0), -gap).alias("penetration"),
        F.when(gap < 0, 1).otherwise(0).alias("active_count"), (F.col("event_id") % 5 - 1).cast("double").alias("normal_velocity"),
    )
