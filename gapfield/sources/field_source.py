"""Binary field files as a data source: ``spark.read.format("field_files")``.

A partition is a byte range of one file, so tasks read only their slice. Filters on the field and on block
coordinates are taken over before partitions are made: other files are not opened, and of a file only the
slices whose blocks can match are read (z is the slowest index of all layouts; the blocks of a
sparse file are in order of z, found by bisection of their 16-byte heads). Spark still applies every filter to the rows.

Options: ``path`` (a folder or a glob of one, any URI that pyarrow opens), ``table``: ``voxels`` (default),
``candidates``, or ``defects``; a file with a bad header or too few bytes has one row there and none elsewhere.
Pushdown needs ``spark.sql.python.filterPushdown.enabled``.

Of at most ``PLANNED`` files the headers are read where partitions are made, and every slice is a partition. Of more,
only those larger than ``WHOLE`` bytes are: the others are dealt to partitions whole, by the listing alone, and
their headers are read in the tasks, so tasks grow with the bytes and not with the files.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from .field_files import HEADER, PLACE, SLICE, VOXEL, _candidate_rows, _read, _sections, _size, _slice, _voxel_rows, gathered, parse_header

NAME = "field_files"
SCHEMAS = {
    "voxels": f"{PLACE}, bi int, bj int, bk int, " + ", ".join(f"{c} double" for c in VOXEL),
    "candidates": f"{PLACE}, rank int, phi double, nx double, ny double, nz double, branch_id bigint",
    "defects": "field_id string, kind string",
}
ARRAYS = {"voxels": ["phi", "n", "h", "w"], "candidates": ["count", "cphi", "cn", "cid"]}


# Files whose headers are read before there are tasks, and the least size of a file for it where there are more.
PLANNED, WHOLE = 64, 8 << 20
# What a partition of whole files holds, in bytes; opening a file counts as so many.
TOGETHER, OPENING = 32 << 20, 64 << 10


class Slice(InputPartition):
    """Cells (or blocks) ``first`` to ``first + count`` of one file, or a defect of it."""

    def __init__(self, head: dict, first: int = 0, count: int = 0, defect: str | None = None):
        self.head, self.first, self.count, self.defect = head, first, count, defect


class Whole(InputPartition):
    """Files (URI, bytes) that one task reads, headers included, within the layers asked for."""

    def __init__(self, files: list[tuple[str, int]], layers: list[int]):
        self.files, self.layers = files, layers


def listed(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files of a folder, or of those that match the pattern in the last part of the path."""
    folder, _, pattern = path.rpartition("/") if "*" in path.rsplit("/", 1)[-1] else (path.rstrip("/"), "", "*")
    system, base = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    root = (folder if ":" in folder else f"file://{folder}")[: -len(base)]
    infos = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((root + i.path, i.size) for i in infos if i.is_file and fnmatch.fnmatch(i.base_name, pattern))


def _field(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class FieldReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "voxels")
        self.wanted: set[str] | None = None
        self.layers = [-(1 << 62), 1 << 62]  # least and largest bk
        self.pushed: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name == "field_id" and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = own if self.wanted is None else self.wanted & own
            elif name == "bk" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low, high = self.layers
                if not isinstance(f, LessThan | LessThanOrEqual):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    high = min(high, f.value - isinstance(f, LessThan))
                self.layers = [low, high]
            else:
                yield f
                continue
            self.pushed.append(str(f))
            yield f  # the rows of a slice that is read may be of other blocks

    def partitions(self) -> list[Slice | Whole]:
        files = [(path, length) for path, length in listed(self.path) if self.wanted is None or _field(path) in self.wanted]
        out, dealt, size = [], [], 0
        for path, length in files:
            if len(files) <= PLANNED or length > WHOLE:
                out += self._parts(path, length)
                continue
            dealt.append((path, length))
            size += length + OPENING
            if size >= TOGETHER:
                out.append(Whole(dealt, self.layers))
                dealt, size = [], 0
        return out + ([Whole(dealt, self.layers)] if dealt else [])

    def _parts(self, path: str, length: int) -> Iterator[Slice]:
        """The slices of one file, by its header."""
        field_id = _field(path)
        try:
            head = parse_header(_read(path, [(0, min(HEADER.size, length))])[0], length)
        except ValueError as e:
            if self.table == "defects":
                yield Slice({"field_id": field_id}, defect=str(e))
            return
        if self.table == "defects" or self.table == "candidates" and not head["stride"]:
            return
        yield from self._slices(head | {"path": path, "field_id": field_id})

    def _slices(self, head: dict) -> Iterator[Slice]:
        d, low, high = head["block_dim"], max(self.layers[0], 0), self.layers[1]
        if head["layout"].startswith("dense"):
            layer = head["dimx"] * head["dimy"]
            first, end, step = low * d * layer, min((high + 1) * d, head["dimz"]) * layer, SLICE
        else:
            width = 16 + _size(_sections(head["layout"], d**3, head["stride"], head["has_hessian"]), d**3)

            def before(bk: int) -> int:
                """How many blocks lie below a layer."""
                a, b = 0, head["blocks"]
                while a < b:
                    mid = (a + b) // 2
                    at = int(np.frombuffer(_read(head["path"], [(HEADER.size + mid * width, 12)])[0], "<i4")[2])
                    a, b = (mid + 1, b) if at < bk else (a, mid)
                return a

            pruned = self.layers != [-(1 << 62), 1 << 62]
            first, end = (before(low), before(high + 1)) if pruned else (0, head["blocks"])
            step = max(1, SLICE // d**3)
        for at in range(first, end, step):
            yield Slice(head, at, min(step, end - at))

    def read(self, partition: Slice | Whole) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Slice):
            return gathered(self._rows(partition))
        self.layers = partition.layers
        return gathered(b for path, length in partition.files for part in self._parts(path, length) for b in self._rows(part))

    def _rows(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if part.defect:
            yield pa.RecordBatch.from_pydict({"field_id": [part.head["field_id"]], "kind": [part.defect]})
            return
        spec = SimpleNamespace(**part.head, first=part.first, count=part.count)
        for index, arrays in _slice(spec, ARRAYS[self.table]):
            yield (_voxel_rows if self.table == "voxels" else _candidate_rows)(spec, index, arrays)


class FieldFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "voxels")]

    def reader(self, schema) -> FieldReader:
        return FieldReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FieldFiles)
