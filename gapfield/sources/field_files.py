"""Import of binary field files into the voxel table, by byte ranges.

All four layouts have fixed strides after the header, so a file is cut into slices of voxels (or of
whole blocks) from its header alone. A task reads only the bytes of its slices; a file of any size
is read by many tasks, and the candidate arrays only when candidates are asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from types import SimpleNamespace
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, spread, task_slots

# Fixed values of the file format: magic, version 0.1.0, flag bits, layout codes, header layout.
MAGIC = b"SDFO"
VERSION = 100
HAS_HESSIAN, SPARSE, CANDIDATES = 1, 2, 4
HEADER = struct.Struct("<4sI3I3d3d3dI32s")
LAYOUTS = {1: "dense", 2: "sparse", 3: "dense_candidates", 4: "sparse_candidates"}
MAX_STRIDE = 8
# Voxels that one slice holds, whole blocks in sparse files.
SLICE = 65536

HESSIAN = ["hxx", "hxy", "hxz", "hyy", "hyz", "hzz"]
VOXEL = ["phi", "nx", "ny", "nz", *HESSIAN, "wx", "wy", "wz"]
HEAD = (
    "path string, field_id string, defect string, bminx double, bminy double, bminz double, bmaxx double, bmaxy double, bmaxz double, "
    "voxx double, voxy double, voxz double, dimx int, dimy int, dimz int, layout string, block_dim int, halo int, blocks bigint, "
    "band double, stride int, has_hessian boolean"
)
HEAD_COLUMNS = [c.split()[0] for c in HEAD.split(", ")]
PLACE = "field_id string, i int, j int, k int"
SPEC = ["path", "field_id", "dimx", "dimy", "dimz", "layout", "block_dim", "stride", "has_hessian", "first", "count"]


def _read(path: str, ranges: list[tuple[int, int]]) -> list[bytes]:
    """The bytes at (offset, length) places of one file."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        return [f.read_at(size, at) for at, size in ranges]


def _sections(layout: str, cells: int, stride: int, hessian: bool) -> dict[str, tuple[str, int]]:
    """The arrays of a dense file or of one block, in file order: element type and elements per cell."""
    dense = layout.startswith("dense")
    real = "<f8" if dense else "<f4"
    out = {"phi": (real, 1), "n": (real, 3)}
    if hessian:
        out["h"] = (real, 6)
    if dense:
        out["w"] = (real, 3)
    if stride:
        out |= {"count": ("<u4" if dense else "u1", 1), "cphi": (real, stride), "cn": (real, 3 * stride), "cid": ("<i4", stride)}
    return out


def _size(sections: dict[str, tuple[str, int]], cells: int) -> int:
    return sum(np.dtype(t).itemsize * n * cells for t, n in sections.values())


def parse_header(raw: bytes, length: int) -> dict:
    """Header fields of a file of ``length`` bytes, or ValueError naming the defect."""
    if len(raw) < HEADER.size:
        raise ValueError("short_header")
    magic, version, *numbers, flags, reserved = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("bad_magic")
    if version != VERSION:
        raise ValueError("bad_version")
    code = struct.unpack_from("<I", reserved)[0]
    sparse, candidates = bool(flags & SPARSE), bool(flags & CANDIDATES)
    if code != 1 + sparse + 2 * candidates:
        raise ValueError("layout_mismatch")
    names = [f"{q}{a}" for q in ("dim", "bmin", "bmax", "vox") for a in "xyz"]
    out = dict(zip(names, numbers)) | {"layout": LAYOUTS[code], "has_hessian": bool(flags & HAS_HESSIAN), "block_dim": 8, "halo": 0, "blocks": 0, "band": 0.0, "stride": 0}
    if sparse:
        out["block_dim"], out["halo"], out["blocks"] = struct.unpack_from("<3I", reserved, 4)
        out["band"] = struct.unpack_from("<d", reserved, 16)[0]
        if not out["block_dim"]:
            raise ValueError("bad_block_dim")
    if candidates:
        out["stride"] = struct.unpack_from("<I", reserved, 24 if sparse else 4)[0]
        if not 0 < out["stride"] <= MAX_STRIDE:
            raise ValueError("bad_stride")
    cells = out["block_dim"] ** 3 if sparse else out["dimx"] * out["dimy"] * out["dimz"]
    body = _size(_sections(out["layout"], cells, out["stride"], out["has_hessian"]), cells)
    if length < HEADER.size + (out["blocks"] * (16 + body) if sparse else body):
        raise ValueError("short_payload")
    return out


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, length in zip(pdf["path"], pdf["length"]):
            row = {"path": path, "field_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0]}
            try:
                row |= parse_header(_read(path, [(0, min(HEADER.size, length))])[0], length)
            except ValueError as e:
                row["defect"] = str(e)
            rows.append(row)
        yield pd.DataFrame(rows, columns=HEAD_COLUMNS, dtype=object)


def _slice(spec, wanted: list[str]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(indices, arrays) of the cells of one slice; sparse fillers outside the grid are left out."""
    nx, ny, nz = spec.dimx, spec.dimy, spec.dimz
    dense = spec.layout.startswith("dense")
    cells = nx * ny * nz if dense else spec.block_dim**3
    sections = _sections(spec.layout, cells, spec.stride, spec.has_hessian)
    wanted = [w for w in wanted if w in sections]
    if dense:
        at, places = HEADER.size, {}
        for name, (t, n) in sections.items():
            width = np.dtype(t).itemsize * n
            places[name] = (at + spec.first * width, spec.count * width)
            at += cells * width
        raw = _read(spec.path, [places[w] for w in wanted])
        lin = np.arange(spec.first, spec.first + spec.count)
        yield np.stack([lin % nx, lin // nx % ny, lin // (nx * ny)], 1), {w: np.frombuffer(r, sections[w][0]).reshape(spec.count, -1) for w, r in zip(wanted, raw)}
        return
    width = 16 + _size(sections, cells)
    raw = _read(spec.path, [(HEADER.size + spec.first * width, spec.count * width)])[0]
    rows = np.frombuffer(raw, "u1").reshape(spec.count, width)
    lin, d = np.arange(cells), spec.block_dim
    local = np.stack([lin % d, lin // d % d, lin // (d * d)], 1)
    index = (rows[:, :12].copy().view("<i4")[:, None, :] * d + local).reshape(-1, 3)
    inside = ((index >= 0) & (index < (nx, ny, nz))).all(1)
    at, arrays = 16, {}
    for name, (t, n) in sections.items():
        size = np.dtype(t).itemsize * n * cells
        if name in wanted:
            arrays[name] = rows[:, at : at + size].copy().view(t).reshape(-1, n)[inside]
        at += size
    yield index[inside], arrays


def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE`` rows: many files hold few rows each."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= SLICE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _each_slice(wanted: list[str], emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                spec = SimpleNamespace(**row)
                for index, arrays in _slice(spec, wanted):
                    yield emit(spec, index, arrays)

    return lambda batches: gathered(run(batches))


def _place(spec, index: np.ndarray) -> dict[str, pa.Array]:
    field = pa.DictionaryArray.from_arrays(np.zeros(len(index), np.int32), [str(spec.field_id)]).cast(pa.string())
    return {"field_id": field} | {c: pa.array(index[:, q].astype("int32")) for q, c in enumerate("ijk")}


def _voxel_rows(spec, index, arrays) -> pa.RecordBatch:
    """Voxels of a slice; second derivatives and closest points that its layout does not store are null."""
    out = _place(spec, index) | {c: pa.array((index[:, q] // spec.block_dim).astype("int32")) for q, c in enumerate(("bi", "bj", "bk"))}
    for name, columns in (("phi", ["phi"]), ("n", ["nx", "ny", "nz"]), ("h", HESSIAN), ("w", ["wx", "wy", "wz"])):
        for q, c in enumerate(columns):
            value = arrays[name][:, q].astype("float64") if name in arrays else None
            optional = name in ("h", "w")
            out[c] = pa.nulls(len(index), pa.float64()) if value is None or optional and np.isnan(value).all() else pa.array(value)
    return pa.RecordBatch.from_pydict(out)


def _candidate_rows(spec, index, arrays) -> pa.RecordBatch:
    cell, rank = np.nonzero(np.arange(spec.stride) < arrays["count"])
    normal = arrays["cn"].reshape(-1, spec.stride, 3)
    values = {"phi": arrays["cphi"][cell, rank], **{f"n{a}": normal[cell, rank, q] for q, a in enumerate("xyz")}}
    out = _place(spec, index[cell]) | {"rank": pa.array(rank.astype("int32"))} | {c: pa.array(v.astype("float64")) for c, v in values.items()}
    return pa.RecordBatch.from_pydict(out | {"branch_id": pa.array(arrays["cid"][cell, rank].astype("int64"))})


def _count_defects(spec, index, arrays) -> pa.RecordBatch:
    bad = bool((arrays["count"] > spec.stride).any())
    return pa.RecordBatch.from_pydict({"field_id": pa.array([spec.field_id] * bad, pa.string())})


def _slices(heads: DataFrame) -> DataFrame:
    """Slices of the files: first voxel or block, and how many."""
    dense = F.col("layout").startswith("dense")
    total = F.when(dense, F.col("dimx").cast("bigint") * F.col("dimy") * F.col("dimz")).otherwise(F.col("blocks"))
    step = F.when(dense, F.lit(SLICE)).otherwise(F.greatest(F.lit(1), F.floor(SLICE / F.pow("block_dim", F.lit(3))))).cast("bigint")
    d = heads.withColumns({"_total": total, "_step": step}).where("_total > 0")
    d = d.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_total") - 1, F.col("_step"))))
    d = d.withColumn("count", F.least(F.col("_step"), F.col("_total") - F.col("first")))
    return spread(d.select(*SPEC), "path", "first")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a glob, in as many partitions as there are task slots.

    A pattern in the last part alone is a filter on one listed folder; Spark would list each file that a glob
    names by a task of its own.
    """
    read = spark.read.format("binaryFile")
    folder, _, pattern = path.rpartition("/")
    if folder and "*" in pattern and not set("*?[]{}\\,") & set(folder) and not set("\\,") & set(pattern):
        # files of folders within that folder are not meant; seen, they would be taken for partitions
        d = read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
        tail = urlsplit(folder).path.rstrip("/") if ":" in folder else folder.rstrip("/")
        d = d.where(F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)").endswith(tail))
    else:
        d = read.load(path)
    return d.select("path", "length").coalesce(task_slots(spark))


def import_field_files(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``fields``, ``voxels``, ``candidates`` and ``defects`` of all files under a glob.

    A file with a bad header, too few bytes, or a candidate count above its stride becomes a defect
    row, and none of its rows are kept. Values that a layout does not store are NULL.
    """
    heads = cut_lineage(_files(spark, path).mapInPandas(_headers, HEAD))
    sound = heads.where("defect is null")
    counted = _slices(sound.where("stride > 0")).mapInArrow(_each_slice(["count"], _count_defects), "field_id string")
    miscounted = cut_lineage(counted.distinct())
    good = sound.join(miscounted, "field_id", "left_anti")
    reals = "rank int, phi double, nx double, ny double, nz double, branch_id bigint"
    voxels = _slices(good).mapInArrow(_each_slice(["phi", "n", "h", "w"], _voxel_rows), f"{PLACE}, bi int, bj int, bk int, " + ", ".join(f"{c} double" for c in VOXEL))
    optional = {c: F.when(~F.isnan(c), F.col(c)) for c in (*HESSIAN, "wx", "wy", "wz")}
    return {
        "fields": good.drop("path", "defect", "blocks"),
        "voxels": voxels.withColumns(optional),
        "candidates": _slices(good.where("stride > 0")).mapInArrow(_each_slice(["count", "cphi", "cn", "cid"], _candidate_rows), f"{PLACE}, {reals}"),
        "defects": heads.where("defect is not null").select("field_id", F.col("defect").alias("kind")).unionByName(miscounted.select("field_id", F.lit("bad_candidate_count").alias("kind"))),
    }
