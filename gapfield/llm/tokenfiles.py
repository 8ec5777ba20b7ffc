"""Token ids of all documents in binary files, with Elias-Fano coded document boundaries.

A file holds the ids of some documents, one after the other, as 16-bit numbers (32-bit where an id needs
them), the boundaries between the documents, and their ids, both as Elias-Fano sequences
(``eliasfano.py``). Documents are in ascending order of doc_id over all files; equal ids are in the
order of the tasks that read them. A file takes about ``FILE_BYTES`` of ids; a longer document has a file of its own.

Layout, little-endian: magic ``EFTOKEN1``; width of an id in bytes (u4), documents without an id (u4, they come first), number
of documents (u8), number of tokens (u8); ids; boundaries (documents + 1 values, from 0); the integer doc_ids.

Encoding: the library encodes every distinct word between white space once per task and the ids are
looked up from then on. Its pieces never hold white space, and normalisation doesn't reach across it, so the
ids of a text are those of its words.

Order: a sample of (doc_id, row number) of at most ``SAMPLE`` rows gives the bounds of the parts, as
range partitioning does, but without encoding twice or staging the ids. Row numbers split an id
that many rows share. A task encodes, finds the part of each row, and the ids are shuffled once. A task then
writes files and reports them as rows of the index, a Parquet table. What the index does not name, such as a file of
a lost attempt, is not part of the data, so a retried task can't harm it. The index also has
the position of every file's first token, by a running sum over parts and one over the files of a part.

Files are read by Spark's own reader and opened in tasks; they are written through pyarrow to the URI of the folder.

Defined results: null or empty text is the end id alone; a null doc_id comes first; equal doc_ids are documents of their own;
other columns are ignored; an empty table gives an index without rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapfield.session import shared_folder

from .blocks import ranges, run_hashes, text_blocks, words
from .common import staged
from .eliasfano import EliasFano
from .slicecache import SliceCache

END_ID = 1
FILE_BYTES = 4 << 20
# Bytes of text that are encoded in one step.
BLOCK_BYTES = 512 << 10
# Rows of the sample that the bounds of the parts come from, and parts at most.
SAMPLE, PARTS = 100_000, 8192
MAGIC = b"EFTOKEN1"
_HEAD = struct.Struct("<8sIIQQ")
_NO_ID = np.iinfo(np.int64).min


class WordEncoder:
    """A tokenizer of the library whose pieces never hold white space, with a cache of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to the other tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache = SliceCache()

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of whole texts (bytes with row offsets) and the row offsets into the ids."""
        starts, ends, row_words = words(data, offs)
        keys, first, inverse = np.unique(run_hashes(data, starts, ends, 5), return_index=True, return_inverse=True)

        def make(missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = first[missing]
            texts = [data[a:b].tobytes().decode() for a, b in zip(starts[own], ends[own], strict=True)]
            ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

        at, size = self.cache.slices(keys, make)
        counts = size[inverse]
        before = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        return self.cache.flat[ranges(at[inverse], counts)], before[row_words]


@cache
def _encoder(path: str) -> WordEncoder:
    """One per process."""
    return WordEncoder(path)


def ended(ids: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and row offsets with the end id behind every row."""
    n = len(rows) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(rows))] = ids
    return out, rows + np.arange(n + 1)


def parts_of(doc_ids: np.ndarray, numbers: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Part of every row: how many bounds are at most (doc_id, row number)."""
    low, high = np.searchsorted(bounds[0], doc_ids, "left"), np.searchsorted(bounds[0], doc_ids, "right")
    part = low.copy()
    for value in np.unique(low[high > low]):
        own = np.flatnonzero((low == value) & (high > low))
        part[own] += np.searchsorted(bounds[1][value : high[own[0]]], numbers[own], "right")
    return part


def _bounds(docs: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Bounds of the parts, and how many parts there are: as many as tasks read the table, ``PARTS`` at most."""
    parts = min(PARTS, max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("d"), F.monotonically_increasing_id().alias("row"))
    total = ids.count()
    share = min(1.0, SAMPLE * 0.8 / max(total, 1))
    drawn = ids.where(F.expr(f"pmod(xxhash64(d, row), 1000000007) < {share} * 1000000007")).limit(SAMPLE).toArrow()
    d, row = drawn.column("d").to_numpy(), drawn.column("row").to_numpy()
    order = np.lexsort((row, d))
    at = np.unique(np.arange(1, parts) * len(order) // parts) if len(order) else np.zeros(0, np.int64)
    return (d[order][at], row[order][at]), parts


def encode(docs: DataFrame, path: str, bounds: tuple[np.ndarray, np.ndarray], end_id: int = END_ID) -> DataFrame:
    """part, doc_id, row, width (bytes an id takes) and ids (binary, little-endian) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(2), BLOCK_BYTES):
                ids, rows = ended(*encoder.encode(data, offs), end_id)
                width = 2 if ids.max(initial=0) < 1 << 16 else 4
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((rows * width).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))])
                doc_id, row = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
                part = parts_of(doc_id.fill_null(_NO_ID).to_numpy(), row.to_numpy(), bounds)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc_id, row, pa.array(np.full(hi - lo, width, np.int32)), packed], ["part", "doc_id", "row", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "part int, doc_id bigint, row bigint, width int, ids binary")


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file of documents in ascending order of their ids, those without an id first."""
    unnamed = sum(d is None for d in doc_ids)
    width = 4 if any(x.dtype.itemsize > 2 for x in ids) else 2
    bounds = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=bounds[1:])
    body = b"".join(x.astype(f"<u{width}").tobytes() for x in ids)
    head = _HEAD.pack(MAGIC, width, unnamed, len(ids), int(bounds[-1]))
    return head + body + EliasFano.of(bounds).tobytes() + EliasFano.of(np.array(doc_ids[unnamed:], np.int64)).tobytes()


class TokenFile:
    """A file read in place: ids of a document by its place, place of a token by its position."""

    def __init__(self, data: bytes):
        magic, width, self.unnamed, self.documents, self.tokens = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ids = np.frombuffer(data, f"<u{width}", self.tokens, _HEAD.size)
        self.bounds, behind = EliasFano.at(data, _HEAD.size + width * self.tokens)
        self.doc_ids, behind = EliasFano.at(data, behind)
        if behind != len(data):
            raise ValueError(f"{len(data)} bytes instead of {behind}")

    def names(self, first: int, last: int) -> list[int | None]:
        nameless = max(0, min(last, self.unnamed) - first)
        return [None] * nameless + self.doc_ids.select(max(first - self.unnamed, 0), max(last - self.unnamed, 0)).tolist()

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(i, i + 2)
        return self.ids[a:b]

    def place(self, position: int) -> int:
        """The document that holds a token."""
        return self.bounds.before(position) - 1


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, most: int = FILE_BYTES) -> DataFrame:
    """Files of all rows of (doc_id, text); the index: name, part, file, documents, tokens, start."""
    folder = folder.rstrip("/")
    bounds, parts = _bounds(docs)

    def opened() -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        return fs, root

    opened()  # a table without rows has a folder too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened()
        names, own, held, made, part = [], [], 0, 0, None

        def flush() -> pa.RecordBatch:
            nonlocal names, own, held, made
            name = f"tokens-{uuid.uuid4().hex}.bin"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(names, own))
            record = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([made], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([sum(map(len, own))], pa.int64())], ["name", "part", "file", "documents", "tokens"])
            names, own, held, made = [], [], 0, made + 1
            return record

        for b in batches:
            for p, doc_id, width, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                ids = np.frombuffer(ids.as_buffer(), f"<u{width}")
                if own and (p != part or held + ids.nbytes > most):
                    yield flush()
                if p != part:
                    part, made = p, 0
                names.append(doc_id)
                own.append(ids)
                held += ids.nbytes
        if own:
            yield flush()

    dealt = encode(docs, path, bounds, end_id).repartition(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "row")
    files = staged(dealt.mapInArrow(run, "name string, part int, file bigint, documents bigint, tokens bigint"))
    # one row per part, PARTS at most, in the first window, the files of a part in the second
    per_part = files.groupBy("part").agg(F.sum("tokens").alias("own"))
    before = per_part.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("tokens")
    return files.withColumn("within", within).join(before, "part").select("name", "part", "file", "documents", "tokens", (F.col("before") + F.col("within")).alias("start"))


def _opened(index: DataFrame, folder: str, fields: str, per_file) -> DataFrame:
    """Rows that ``per_file`` (a TokenFile -> arrow arrays) yields for every file of the folder, with the index."""
    spark = index.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", *(f.split()[0] for f in fields.split(", "))]
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                name = path.as_py().rsplit("/", 1)[-1]
                for arrays in per_file(TokenFile(content.as_buffer())):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(arrays[0])), *arrays], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder).select("path", "content")
    # a file that the index doesn't name belongs to a lost attempt and may be torn
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(index.select("name")) if index.count() < BROADCAST_FILES else index.select("name"), "name", "left_semi").select("path", "content")
    return named.mapInArrow(run, f"name string, {fields}").join(index.select("name", F.col("start").alias("before")), "name")


# Names of this many files, of 44 bytes each, are sent to all executors at most.
BROADCAST_FILES = 100_000


def digests(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files."""

    def per_file(f: TokenFile) -> Iterator[list[pa.Array]]:
        for lo in range(0, f.documents, 4096):
            hi = min(lo + 4096, f.documents)
            bounds = f.bounds.select(lo, hi + 1)
            crc = [zlib.crc32(f.ids[a:b].astype("<u4")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield [pa.array(f.names(lo, hi), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]

    rows = _opened(index, folder, "doc_id bigint, own bigint, n_tokens bigint, ids_crc32 bigint", per_file)
    return rows.select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def documents(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, ids (array) of all documents, from the files."""

    def per_file(f: TokenFile) -> Iterator[list[pa.Array]]:
        for lo in range(0, f.documents, 256):
            hi = min(lo + 256, f.documents)
            bounds = f.bounds.select(lo, hi + 1)
            ids = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(f.ids[bounds[0] : bounds[-1]].astype(np.int32)))
            yield [pa.array(f.names(lo, hi), pa.int64()), pa.array(bounds[:-1]), ids]

    rows = _opened(index, folder, "doc_id bigint, own bigint, ids array<int>", per_file)
    return rows.select("doc_id", (F.col("before") + F.col("own")).alias("start"), "ids")


def written(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """The index and the folder of the files of all documents; a new one in the shared folder, if none is given."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return staged(write(docs, path, folder, end_id)), folder
