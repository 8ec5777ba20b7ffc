"""Model text files: entities, typed entity tables and embedded surfaces, in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import numbers, truth, unquote
from ..functions.vec import AXES
from ..operators.ordered import running
from ..session import cut_lineage
from .lines import ORDER, read_lines

# Entity kinds of the format. TYPED kinds get a table, SETTINGS kinds a key/value table.
TYPED = (
    "PART", "MARKER", "JOINT", "MOTION", "EXPRESSION", "GGEOM", "GGEOMCONTACT",
    "AXIAL_FORCE", "ACCGRAV", "UNITS",
)
SETTINGS = ("OUTPUT", "INTPAR", "EQUILIBRIUM", "SOLVEROPTION", "STOPBYCONDITION", "INFO")
# The kinds that end a patch list.
HARD = TYPED + SETTINGS
JOINT_TYPES = ("FIXED", "REVOLUTE", "CYLINDRICAL", "TRANSLATIONAL")

START = r"^(\w+)\s*/"
START_ID = r"^\w+\s*/\s*(\d+)"


def read_entities(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return parse_entities(read_lines(spark, path))


def parse_entities(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entities(file, ent_no, kind, ent_id, line_start, attrs, first_line)`` and
    ``entity_lines(file, line_start, kind, ent_id, line_no, line)``.

    An entity starts at ``KIND / id`` and goes on while lines start with a comma; ``!`` lines
    are comments, a blank line ends it, ``END`` ends the file. After a ``PATCHES`` line the
    entity takes every line up to the next known kind. Lines stay one row each: an entity may
    hold millions of patch rows, which are never gathered into one value.
    """
    d = lines.withColumn("_s", F.trim(F.regexp_replace("line", r"\s+", " ")))
    s = F.col("_s")
    up = F.upper(s)
    kind = F.upper(F.regexp_extract(s, START, 1))
    comment = s.startswith("!")
    is_start = (kind != "") & ~comment
    hard = is_start & kind.isin(*HARD)
    patches = up.contains("PATCHES") & ~is_start & ~comment
    stop = (s == "") | (~comment & ~s.startswith(",") & ~patches & ~is_start)
    d = d.withColumns(
        {
            "_kind": kind, "_id": F.coalesce(F.regexp_extract(s, START_ID, 1).try_cast("bigint"), F.lit(0)),
            "_start": is_start, "_hard": hard, "_patch": patches, "_stop": stop, "_end": up == "END", "_cmt": comment,
        }
    )
    # the running values read the rows several times, each with columns of its own: the text is parsed once before
    d = cut_lineage(d)
    at = F.struct(F.col("block"), F.col("pos"))
    d = running(
        d, ["file"], ORDER, F.col("block"),
        sums={
            "line_no": F.lit(1).cast("bigint"), "_ends": F.col("_end").cast("bigint"), "_seg": F.col("_hard").cast("bigint"),
        },
        last={
            "_ent": F.when(F.col("_start"), F.struct("block", "pos", F.col("_kind").alias("kind"), F.col("_id").alias("id"))),
            "_open": F.when(F.col("_start"), F.lit(True)).when(F.col("_stop"), F.lit(False)),
        },
    ).filter(F.col("_ends") == 0)
    opened = F.coalesce("_open", F.lit(False))
    d = running(
        d, ["file", "_seg"], ORDER, F.col("block"),
        mins={"_p": F.when(F.col("_patch") & opened, F.struct("block", "pos", F.col("_ent").alias("ent")))},
    )
    p = F.col("_p")
    in_patch = p.isNotNull() & (F.struct(p["block"].alias("block"), p["pos"].alias("pos")) < at)
    live = F.when(in_patch, F.col("_s") != "").otherwise(opened) & ~F.col("_cmt")
    d = d.withColumns({"_in": in_patch, "_e": F.when(in_patch, p["ent"]).otherwise(F.col("_ent"))}).filter(live)
    rows = d.select(
        "file", F.col("_e.block").alias("eb"), F.col("_e.pos").alias("ep"), F.col("_e.kind").alias("kind"),
        F.col("_e.id").alias("ent_id"), F.col("line_no"), "line", "_s",
        (F.col("_start") & ~F.col("_in")).alias("_head"),
    )
    # every typed table reads these rows: stage them once instead of parsing the text again
    rows = cut_lineage(rows)
    ent_key = ["file", "eb", "ep", "kind", "ent_id"]
    body = F.trim(F.regexp_replace("_s", r"^,", ""))
    pair = rows.filter(F.col("_s").contains("=")).select(
        *ent_key, "line_no", F.upper(F.trim(F.regexp_extract(body, r"^([^=]*)=", 1))).alias("_k"),
        F.trim(F.regexp_extract(body, r"^[^=]*=(.*)$", 1)).alias("_v"),
    )
    joined = pair.groupBy(*ent_key, "_k").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_v"))), lambda e: e["_v"])).alias("_v")
    )
    attrs = joined.groupBy(*ent_key).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("attrs"))
    heads = rows.filter("_head").select(*ent_key, (F.col("line_no") - 1).alias("line_start"), F.col("line").alias("first_line"))
    empty = F.create_map().cast("map<string,string>")
    ents = heads.join(attrs, ent_key, "left").withColumn("attrs", F.coalesce("attrs", empty))
    ents = running(ents, ["file"], ["line_start"], F.col("eb"), sums={"ent_no": F.lit(1).cast("bigint")})
    ents = ents.select("file", "ent_no", "kind", "ent_id", "line_start", "attrs", "first_line", "eb", "ep")
    tagged = rows.join(heads.select("file", "eb", "ep", "line_start"), ["file", "eb", "ep"])
    lines_out = tagged.select("file", "line_start", "kind", "ent_id", "line_no", "line")
    return cut_lineage(ents.drop("eb", "ep")), lines_out


def _attr(key: str) -> Column:
    return F.try_element_at("attrs", F.lit(key))


def _int(key: str, default=None) -> Column:
    v = F.when(_attr(key).rlike(r"^\s*[+-]?\d+\s*$"), _attr(key).try_cast("bigint"))
    return v if default is None else F.coalesce(v, F.lit(default).cast("bigint"))


def _float(key: str, default=None) -> Column:
    v = _attr(key).try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def _ref(key: str) -> Column:
    return _attr(key).try_cast("double").cast("bigint")


def _name() -> Column:
    return F.coalesce(unquote(_attr("NAME")), F.lit(""))


def _function() -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_attr("FUNCTION"), F.lit("")), r"\\+$", ""))


def _triple(key: str) -> Column:
    v = numbers(_attr(key))
    return F.when(F.size(v) >= 3, F.slice(v, 1, 3))


def entity_tables(entities: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """One typed table per entity kind, with the format's defaults; unknown kinds kept aside."""

    def of(kind):
        return entities.filter(F.col("kind") == kind)

    ip = numbers(_attr("IP"))
    parts = of("PART").select(
        "file", F.col("ent_id").alias("body_id"), _name().alias("name"),
        F.array_contains(F.transform(F.split("first_line", ","), lambda x: F.trim(x)), "GROUND").alias("ground"),
        _float("MASS", 1.0).alias("mass"), _ref("CM").alias("cm_marker_id"),
        F.when(F.size(ip) >= 6, F.slice(ip, 1, 6)).alias("ip"), _triple("QG").alias("qg"), _triple("REULER").alias("reuler"),
    )
    markers = of("MARKER").select(
        "file", F.col("ent_id").alias("marker_id"), _name().alias("name"), _ref("PART").alias("part_id"),
        _triple("QP").alias("qp"), _triple("REULER").alias("reuler"),
    )
    word = F.upper(F.regexp_replace(F.trim("line"), r"^[, ]+", ""))
    jt = (
        lines.filter((F.col("kind") == "JOINT") & word.isin(*JOINT_TYPES))
        .groupBy("file", "line_start")
        .agg(F.min_by(F.lower(word), "line_no").alias("type"))
    )
    joints = of("JOINT").join(jt, ["file", "line_start"], "left").select(
        "file", F.col("ent_id").alias("joint_id"), _name().alias("name"), F.coalesce("type", F.lit("")).alias("type"),
        _ref("I").alias("marker_i"), _ref("J").alias("marker_j"),
    )
    motions = of("MOTION").select(
        "file", F.col("ent_id").alias("motion_id"), _name().alias("name"), _ref("JOINT").alias("joint_id"),
        F.when(_attr("VELOCITY").isNotNull(), "velocity").otherwise("displacement").alias("motion_type"),
        _attr("ROTATION").isNotNull().alias("is_rotation"), _function().alias("function_expr"),
    )
    expressions = of("EXPRESSION").select(
        "file", F.col("ent_id").alias("expr_id"), _name().alias("name"), _function().alias("function_expr")
    )
    surfaces = of("GGEOM").select(
        "file", F.col("ent_id").alias("surface_id"), _name().alias("name"), _ref("RM").alias("rm_marker_id"),
        _int("NO_PATCH", 0).alias("num_patches"), _int("NO_NODE", 0).alias("num_nodes"),
    )
    contacts = of("GGEOMCONTACT").select(
        "file", F.col("ent_id").alias("contact_id"), _name().alias("name"),
        _int("IGGEOMID", 0).alias("iggeom"), _int("JGGEOMID", 0).alias("jggeom"),
        _int("IFLOAT", 0).alias("ifloat"), _int("JFLOAT", 0).alias("jfloat"),
        _float("K", 100000.0).alias("k"), _int("KORDER", 1).alias("korder"), _float("C", 10.0).alias("c"),
        _float("D_F_C", 0.0).alias("d_f_c"), _float("S_F_C", 0.0).alias("s_f_c"),
        _float("S_T_V", 0.1).alias("s_t_v"), _float("BPEN", 0.01).alias("bpen"),
    )
    forces = of("AXIAL_FORCE").select(
        "file", F.col("ent_id").alias("force_id"), _name().alias("name"), _int("I", 0).alias("marker_i"),
        _int("J", 0).alias("marker_j"), _function().alias("function_expr"),
        _attr("TRANSLATION").isNotNull().alias("is_translation"),
    )
    gravity = of("ACCGRAV").select("file", F.coalesce(F.get(numbers(_attr("KGRAV")), F.lit(0)), F.lit(0.0)).alias("g"), "ent_no")
    gravity = gravity.groupBy("file").agg(F.max_by("g", "ent_no").alias("g"))
    units = of("UNITS").select("file", "ent_no", F.explode("attrs").alias("key", "value"))
    units = units.groupBy("file", "key").agg(unquote(F.max_by("value", "ent_no")).alias("value"))
    settings = entities.filter(F.col("kind").isin(*SETTINGS)).select("file", "ent_no", F.explode("attrs").alias("key", "value"))
    settings = settings.groupBy("file", "key").agg(F.max_by("value", "ent_no").alias("value"))
    unknown = entities.filter(~F.col("kind").isin(*HARD))
    return {
        "parts": parts, "markers": markers, "joints": joints, "motions": motions, "expressions": expressions,
        "surfaces": surfaces, "contacts": contacts, "axial_forces": forces, "gravity": gravity, "units": units,
        "settings": settings, "unknown": unknown, "entities": entities,
    }


def entity_meshes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surfaces inside the entities: NODES rows of three numbers, PATCHES rows ``3, a, b, c``.

    The mesh id is ``file#id``; vertex ids are 0-based. Surfaces without nodes or without
    triangles are left out.
    """
    d = lines.filter(F.col("kind") == "GGEOM").withColumn("_s", F.trim("line"))
    up = F.upper("_s")
    d = d.withColumns({"mesh_id": F.concat_ws("#", "file", "ent_id"), "_nodes": up.contains(", NODES"), "_pats": up.contains(", PATCHES")})
    mode = F.when(F.col("_nodes"), "n").when(F.col("_pats"), "p")
    key = ["mesh_id", "line_start"]
    # a surface may be most of its file: bucket its lines by line number
    d = running(d, key, ["line_no"], F.floor(F.col("line_no") / 1_000_000), last={"_mode": mode})
    d = d.filter(~F.col("_nodes") & ~F.col("_pats"))
    parts = F.filter(F.transform(F.split(F.regexp_replace("_s", r"^,+", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    xyz = F.transform(parts, lambda x: x.try_cast("double"))
    d = d.withColumns({"_xyz": xyz, "_ids": F.transform(F.split("_s", ","), lambda x: F.trim(x).try_cast("bigint"))})
    full = F.forall("_xyz", lambda x: x.isNotNull())
    is_node = (F.col("_mode") == "n") & (F.size("_xyz") == 3) & full
    ids = [F.get("_ids", F.lit(i)) for i in (1, 2, 3)]
    is_tri = (F.col("_mode") == "p") & F.col("_s").startswith("3,") & ids[0].isNotNull() & ids[1].isNotNull() & ids[2].isNotNull()
    d = d.withColumns({"_n": F.coalesce(is_node, F.lit(False)), "_t": F.coalesce(is_tri, F.lit(False))})
    d = running(d, key, ["line_no"], F.floor(F.col("line_no") / 1_000_000), sums={"_vn": F.col("_n").cast("bigint"), "_tn": F.col("_t").cast("bigint")})
    both = d.groupBy("mesh_id").agg(F.bool_or("_n").alias("a"), F.bool_or("_t").alias("b")).filter("a and b").select("mesh_id")
    d = d.join(both, "mesh_id", "left_semi")
    v = d.filter("_n").select("mesh_id", (F.col("_vn") - 1).alias("vid"), *[F.col("_xyz")[i].alias(a) for i, a in enumerate(AXES)])
    f = d.filter("_t").select("mesh_id", (F.col("_tn") - 1).alias("tri_id"), *[(F.col("_ids")[i] - 1).alias(f"v{i - 1}") for i in (1, 2, 3)])
    return v, f


__all__ = ["entity_meshes", "entity_tables", "parse_entities", "read_entities", "truth"]
