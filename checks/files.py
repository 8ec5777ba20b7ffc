"""Binary field files of all four layouts, written from the supplier spheres and read back."""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import functions as F

from gapfield.operators import query as Q
from gapfield.sources import field_files, field_source, store

from . import fields as FQ
from . import sql as S
from . import tables as T
from .evaluation import shared_folder
from .registry import query, rounded, session_with

X = S.X
STRIDE, DIM = 3, 4
# Files that are written from one group of rows, neighbours by key.
AT_ONCE = 32


def packed(pdf, key: int) -> bytes:
    """The file of one field: layout by its key, every fifth spoiled in one of four ways."""
    sparse, several = key % 2 == 1, key // 2 % 2 == 1
    real = "<f4" if sparse else "<f8"
    at, phi, n = (pdf[c].to_numpy() for c in (["i", "j", "k"], "phi", ["nx", "ny", "nz"]))
    block = at // DIM
    # cells by z, y, x; in a sparse file blocks of four by z, y, x and cells within
    order = np.lexsort([*at.T, *block.T] if sparse else at.T)
    at, phi, n, block = at[order], phi[order], n[order], block[order]

    def arrays(rows: slice) -> bytes:
        p, q = phi[rows], n[rows]
        out = [p.astype(real).tobytes(), q.astype(real).tobytes()]
        if not sparse:
            out.append(((at[rows] + 0.5) * 0.25 - 1.0 - p[:, None] * q).astype(real).tobytes())
        if several:
            r = np.arange(STRIDE)
            count = np.where(at[rows].sum(1) % 3 == 0, 0, STRIDE)
            turned = q[:, None, :] + 0.1 * r[None, :, None] * np.roll(q, -1, 1)[:, None, :]
            out += [count.astype("u1" if sparse else "<u4").tobytes(), (p[:, None] - 0.05 * r).astype(real).tobytes(), turned.astype(real).tobytes(), np.tile(r + 1, (len(p), 1)).astype("<i4").tobytes()]
        return b"".join(out)

    starts = [q for q in range(0, len(phi), DIM**3) if np.abs(phi[q : q + DIM**3]).min() <= 0.1] if sparse else []
    groups = [(block[q], slice(q, q + DIM**3)) for q in starts]
    reserved = struct.pack("<I", 1 + sparse + 2 * several)
    if sparse:
        reserved += struct.pack("<3Id", DIM, 0, len(groups), 0.1)
    if several:
        reserved = reserved.ljust(24 if sparse else 4, b"\0") + struct.pack("<I", STRIDE)
    flags = field_files.SPARSE * sparse + field_files.CANDIDATES * several
    magic, version = field_files.MAGIC, field_files.VERSION
    body = b"".join(struct.pack("<4i", *index, 0) + arrays(rows) for index, rows in groups) if sparse else arrays(slice(None))
    if key % 5 == 4:
        kind = key // 5 % 4
        magic, version = (b"XXXX" if kind == 0 else magic), (version + 1 if kind == 1 else version)
        flags ^= field_files.CANDIDATES if kind == 2 else 0
        body = body[: len(body) // 2] if kind == 3 else body
    return field_files.HEADER.pack(magic, version, 8, 8, 8, *[-1.0] * 3, *[1.0] * 3, *[0.25] * 3, flags, reserved.ljust(32, b"\0")) + body


def written(spark, sf) -> str:
    """A new folder with one file per supplier."""
    base = shared_folder(spark)
    folder = base if ":" in base else f"file://{base}"

    def several(pdf):
        system, root = fs.FileSystem.from_uri(folder)
        for key, one in pdf.groupby("field_id"):
            with system.open_output_stream(f"{root}/.{key}.part") as f:
                f.write(packed(one, key))
            system.move(f"{root}/.{key}.part", f"{root}/{key}.sdf")
        return pdf[["field_id"]].head(1)

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    T.sphere_voxels(spark, sf, hess=False).groupBy(F.floor(F.col("field_id") / AT_ONCE)).applyInPandas(several, "field_id bigint").count()
    return folder


def _source(spark, folder: str, table: str):
    spark = session_with(spark, **{"spark.sql.python.filterPushdown.enabled": "true"})
    field_source.register(spark)
    return spark.read.format(field_source.NAME).option("path", f"{folder}/*.sdf").option("table", table).load()


# layouts by the key: 0 dense, 1 sparse, 2 dense with candidates, 3 sparse with candidates
_FILES = f"""act AS (SELECT field_id, bi, bj, bk FROM vox GROUP BY ALL HAVING min(abs(phi)) <= 1e-1),
fv AS (SELECT v.field_id, v.i, v.j, v.k, v.bi, v.bj, v.bk, v.field_id % 2 = 1 AS sparse, v.phi AS dphi, {', '.join(f'v.n{a} AS dn{a}' for a in X)},
 {', '.join(f'CASE WHEN v.field_id % 2 = 1 THEN CAST(CAST(v.{c} AS FLOAT) AS DOUBLE) ELSE v.{c} END AS {c}' for c in ('phi', 'nx', 'ny', 'nz'))}
 FROM vox v LEFT JOIN act a ON v.field_id = a.field_id AND v.bi = a.bi AND v.bj = a.bj AND v.bk = a.bk WHERE v.field_id % 5 <> 4 AND (v.field_id % 2 = 0 OR a.field_id IS NOT NULL))"""
_witness = "CASE WHEN sparse THEN NULL ELSE round((i+5e-1)*25e-2-1e0 - dphi*dnx, 5) + 0.0 END AS wx"




def _stored(value):
    return f"CASE WHEN sparse THEN CAST(CAST({value} AS FLOAT) AS DOUBLE) ELSE {value} END"


@query("field_source_layouts", S.with_(S.SPHERES, _FILES) + f"SELECT field_id, i, j, k, {S.r6('phi', 'phi', 5)}, {S.r6('ny', 'ny', 5)}, {_witness} FROM fv")
def field_source_layouts(spark, sf):
    """Voxels of four layouts through the data source; files with a bad header give none."""
    d = _source(spark, written(spark, sf), "voxels")
    return _typed(d.select("field_id", "i", "j", "k", "phi", "ny", "wx"), ["phi", "ny", "wx"])


@query("field_source_pushed", S.with_(S.SPHERES, _FILES) + f"SELECT field_id, i, j, k, {S.r6('phi', 'phi', 5)} FROM fv WHERE (bk < 1 OR NOT sparse) AND field_id IN (1, 2, 3, 6, 8)")
def field_source_pushed(spark, sf):
    """The lowest blocks of some fields (a dense file is one block): other files and layers are not read."""
    d = _source(spark, written(spark, sf), "voxels").where(F.col("field_id").isin("1", "2", "3", "6", "8") & (F.col("bk") < 1))
    return _typed(d.select("field_id", "i", "j", "k", "phi"), ["phi"])


@query("field_source_candidates", S.with_(S.SPHERES, _FILES) + f"SELECT field_id, i, j, k, CAST(r AS INTEGER) AS rank, {S.r6(_stored('dphi - r*5e-2'), 'phi', 5)}, {S.r6(_stored('dnx + r*1e-1*dny'), 'nx', 5)} FROM fv, range(3) g(r) WHERE field_id % 4 >= 2 AND (i+j+k) % 3 <> 0")
def field_source_candidates(spark, sf):
    d = _source(spark, written(spark, sf), "candidates")
    return _typed(d.select("field_id", "i", "j", "k", "rank", "phi", "nx"), ["phi", "nx"])


@query("field_source_defects", "SELECT CAST(s_suppkey AS BIGINT) AS field_id, CASE s_suppkey // 5 % 4 WHEN 0 THEN 'bad_magic' WHEN 1 THEN 'bad_version' WHEN 2 THEN 'layout_mismatch' ELSE 'short_payload' END AS kind FROM supplier WHERE s_suppkey % 5 = 4")
def field_source_defects(spark, sf):
    d = _source(spark, written(spark, sf), "defects")
    return d.select(F.col("field_id").cast("bigint").alias("field_id"), "kind")


@query("field_import_layouts", S.with_(S.SPHERES, _FILES) + f"SELECT field_id, i, j, k, {S.r6('phi', 'phi', 5)}, {S.r6('nz', 'nz', 5)}, {_witness} FROM fv")
def field_import_layouts(spark, sf):
    """The same files through the import by byte ranges."""
    d = field_files.import_field_files(spark, f"{written(spark, sf)}/*.sdf")["voxels"]
    return _typed(d.select("field_id", "i", "j", "k", "phi", "nz", "wx"), ["phi", "nz", "wx"])


def _typed(d, values):
    return rounded(d.withColumns({c: F.col(c).cast("bigint") for c in ("field_id", "i", "j", "k")}), values, 5)


# ---- bucketed store ---------------------------------------------------------------------------------

CO_LOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def _buckets(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(spark, sf, rows, dealt=False):
    """The rows written as a bucketed table, attached under another name as a later session would."""
    own = session_with(spark, **CO_LOCATED)
    name, path, n = f"gf_{uuid.uuid4().hex}", shared_folder(spark), _buckets(own)
    store.write_bucketed(rows(own, sf), name, path, n, dealt)
    own.sql(f"DROP TABLE {name}")
    return own, store.attach_bucketed(own, name, path, n)


@query("bucketed_second", S.with_(*FQ.BASE, FQ.TAYLOR, FQ.SECOND) + FQ._results("se", "ok"))
def bucketed_second(spark, sf):
    """Points against stored voxels that stay in their buckets."""
    own, v = bucketed(spark, sf, T.sphere_voxels)
    r = Q.query(T.sphere_points(own, sf), T.sphere_fields(own, sf), v, "second")
    return rounded(r.select("field_id", "qid", "valid", *FQ.VALS), FQ.VALS)


@query("bucketed_tricubic", S.with_(*FQ.BASE, FQ.CORNERS, FQ._cell(True, "tc")) + FQ._results("tc", "ok"))
def bucketed_tricubic(spark, sf):
    """The same against a stored cell table."""
    own, c = bucketed(spark, sf, lambda s, d: Q.cell_table(T.sphere_voxels(s, d, hess=False), buckets=_buckets(s)), dealt=True)
    r = Q.query(T.sphere_points(own, sf), T.sphere_fields(own, sf), None, "tricubic", cells=c)
    return rounded(r.select("field_id", "qid", "valid", *FQ.VALS), FQ.VALS)


@query("field_store_one", S.with_(S.SPHERES) + f"SELECT field_id, i, j, k, {S.r6s(['phi', 'nx'])} FROM vox WHERE field_id = 3")
def field_store_one(spark, sf):
    """One field out of a store of all."""
    root = shared_folder(spark)
    store.write_field(T.sphere_fields(spark, sf), T.sphere_voxels(spark, sf, hess=False), root, mode="overwrite")
    _, v = store.read_field(spark, root, 3)
    return rounded(v.select("field_id", "i", "j", "k", "phi", "nx"), ["phi", "nx"])
