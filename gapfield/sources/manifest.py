"""Geometry manifest: which mesh and field belong to which body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unquote
from ..operators.ordered import running
from .lines import ORDER, read_lines

SCHEMA = "bodies map<string, struct<mesh:string, sdf:string, surface_role:string, body_id:bigint>>"
# Fixed value: the role of an entry that names none.
DEFAULT_ROLE = "quadrature_and_sdf"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``manifest(body_name, mesh_id, field_id, surface_role, body_id)`` from JSON
    ``{"bodies": {name: {mesh, sdf, surface_role, body_id}}}``, one document per file."""
    d = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return d.select(F.explode("bodies").alias("body_name", "e")).select(
        "body_name", F.col("e.mesh").alias("mesh_id"), F.col("e.sdf").alias("field_id"),
        F.coalesce("e.surface_role", F.lit(DEFAULT_ROLE)).alias("surface_role"), F.col("e.body_id").alias("body_id"),
    )


def read_manifest_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same table from YAML text."""
    return parse_manifest(read_lines(spark, path))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Manifest rows from lines of ``bodies:``, body names below it, and ``key: value`` below those.

    Only this nesting is read, told by indentation: none, some, and more than the body's own.
    Comments, blank lines and other top-level sections are skipped; ``null`` and ``~`` are NULL.
    """
    text = F.regexp_replace(F.regexp_replace("line", r"(^|\s)#.*$", ""), r"\s+$", "")
    part = lambda n: F.regexp_extract(text, r"^( *)([^:]+):\s*(.*)$", n)
    d = lines.withColumns({"_indent": F.length(part(1)), "_key": unquote(part(2)), "_value": part(3)}).filter("_key <> ''")
    opens = (F.col("_value") == "") & (F.col("_indent") > 0)
    d = running(d, ["file"], ORDER, F.col("block"), last={
        "_section": F.when(F.col("_indent") == 0, F.col("_key")),
        "_body": F.when(opens, F.struct("_key", "_indent")),
    })
    d = d.filter((F.col("_section") == "bodies") & F.col("_body").isNotNull() & (F.col("_indent") >= F.col("_body._indent")))
    value = F.when(~F.col("_value").isin("", "null", "~"), F.regexp_replace("_value", r"""^(["'])(.*)\1$""", "$2"))
    own = F.col("_indent") > F.col("_body._indent")
    pick = lambda key: F.max(F.when(own & (F.col("_key") == key), value))
    d = d.groupBy("file", F.col("_body._key").alias("body_name")).agg(
        pick("mesh").alias("mesh_id"), pick("sdf").alias("field_id"), pick("surface_role").alias("surface_role"), pick("body_id").alias("body_id")
    )
    return d.select("body_name", "mesh_id", "field_id", F.coalesce("surface_role", F.lit(DEFAULT_ROLE)).alias("surface_role"), F.col("body_id").try_cast("bigint").alias("body_id"))


def resolve(bodies: DataFrame, manifest: DataFrame, role: str | None = None) -> DataFrame:
    """Bodies with their mesh and field; ``role`` keeps one surface role only."""
    m = manifest if role is None else manifest.filter(F.col("surface_role") == role)
    return bodies.join(m.drop("body_id").withColumnRenamed("body_name", "name"), "name", "left")
