"""Whitened vectors: projections on the eigenvectors of the covariance, in units of its spread.

Components are integers floor(64 c) + 1,000,000. A first pass over the vectors gives their number
and the sums per dimension, exactly; a second the products of the entries less a whole number near
their mean, again exactly, in blocks that fit 53 bits; a third the covariance of the whitened values
themselves, which ``identity_error`` is taken from. What tasks send is one row per task and
dimension or pair of dimensions, summed by Spark; the driver gets one number per pair of dimensions
(their number is bounded by ``DIMENSIONS``) and finds the eigenpairs there (``feast.py``). No vector
leaves its task, and nothing is shuffled but sums.

Defined results: vectors that are null or hold null or non-finite entries have no rows, nor have
those with an entry of 2^52 or more after scaling; vectors of different lengths are fitted and whitened apart, each with
its own n; an empty vector has no components; a component with eigenvalue zero up to rounding has a null ``whitened`` and
doesn't count in ``identity_error``, which is null if no component counts; ``explained`` is 0 if all
vectors agree; repeated rows count each; a null id is carried; a ``deviation`` that no long holds is
null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feast

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
DIMENSIONS = 4096
_ROWS = 2048
_EXACT = 1 << 53


def _entries(column: pa.Array, scale: int, shift: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: row numbers and integer matrix of the usable ones."""
    offs = np.asarray(column.offsets)
    flat = column.values.slice(offs[0], offs[-1] - offs[0]) if len(offs) else column.values
    bad = np.asarray(flat.is_null())
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * np.asarray(flat.cast(pa.float64()).fill_null(0.0)))
    bad = bad | ~(np.abs(x) < 1 << 52)
    count = np.zeros(len(bad) + 1, np.int64)
    np.cumsum(bad, out=count[1:])
    at = offs - offs[0]
    lens = np.diff(at)
    keep = np.asarray(column.is_valid()) & (count[at[1:]] == count[at[:-1]]) & (lens > 0)
    x = np.where(bad, 0, x).astype(np.int64) + shift
    return {int(d): (rows := np.flatnonzero(keep & (lens == d)), x[at[rows][:, None] + np.arange(d)]) for d in np.unique(lens[keep])}


def _sums(parts: np.ndarray) -> np.ndarray:
    """Sum over rows as Python integers where 64 bits might not do."""
    most = max(abs(int(parts.max(initial=0))), abs(int(parts.min(initial=0))))
    return parts.sum(0) if most * len(parts) < 1 << 62 else parts.astype(object).sum(0)


def _gram(z: np.ndarray) -> np.ndarray:
    """Exact products of all columns, by double-precision products where they are exact."""
    most = max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0))))
    if most * most * len(z) < _EXACT:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    if most * most * len(z) < 1 << 62:
        return z.T @ z
    return z.astype(object).T @ z.astype(object)


def _summed(rows: DataFrame, scale: int, shift: int, dims: tuple[int, ...], per_block) -> dict[int, list[int]]:
    """By length: what ``per_block`` (length, matrix) -> flat integers adds up to over all rows, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, (_, x) in _entries(b.column(0), scale, shift).items():
                for i in range(0, len(x), _ROWS):
                    own = per_block(d, x[i : i + _ROWS]).astype(object)
                    total[d] = own + total[d] if d in total else own
        for d, values in total.items():
            text = [str(v) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(text), pa.int32()), pa.array(np.arange(len(text)), pa.int64()), pa.array(text)], ["dim", "at", "part"])

    parts = rows.select("embedding").mapInArrow(run, "dim int, at bigint, part string")
    if dims:
        parts = parts.where(F.col("dim").isin(*dims))
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("dim", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).orderBy("dim", "at").collect():
        out.setdefault(r.dim, []).append(int(r.total))
    return out


class Fit:
    """Number, sums, eigenvalues and vectors of one length of vectors; all covariances by n."""

    def __init__(self, n: int, sums: list[int], centre: np.ndarray, products: list[int], components: int):
        d = len(sums)
        self.n, self.sums = n, sums
        # sums of x - centre, and the upper triangle of their products, as exact integers
        rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
        self.covariance = np.zeros((d, d))
        for (i, j), p in zip(zip(*np.triu_indices(d), strict=True), products, strict=True):
            self.covariance[i, j] = self.covariance[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
        self.trace = float(np.trace(self.covariance))
        values, vectors = feast.largest(self.covariance, min(components, d))
        self.values = np.where(values > 1e-12 * max(self.trace, 0.0), values, 0.0)
        self.explained = self.values / self.trace if self.trace else np.zeros(len(values))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.axes = np.where(self.values > 0, vectors / np.sqrt(self.values), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        s = self.sums
        most = max(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n, max(map(abs, s), default=0))
        return self.n * x - np.array(s, np.int64) if most < 1 << 61 else self.n * x.astype(object) - np.array(s, object)

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened values per row, and the deviation per row, null where 64 bits don't hold it."""
        w = self.centred(x)
        most = max(abs(int(w.max(initial=0))), abs(int(w.min(initial=0))))
        if most * most * w.shape[1] < 1 << 63:
            deviation = (w * w).sum(1).tolist()
        else:
            deviation = [v if v < 1 << 63 else None for v in (w.astype(object) ** 2).sum(1)]
        return (w / self.n).astype(np.float64) @ self.axes, deviation


def fits(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> dict[int, Fit]:
    """A fit for every length of vectors."""
    first = _summed(rows, scale, shift, (), lambda d, x: np.append(_sums(x), len(x)))
    if not first:
        return {}
    if max(first) > DIMENSIONS:
        raise ValueError(f"vectors of {max(first)} numbers; at most {DIMENSIONS} are fitted")
    centres = {d: np.array([s // v[-1] for s in v[:-1]], np.int64) for d, v in first.items()}
    second = _summed(rows, scale, shift, tuple(first), lambda d, x: _gram(x - centres[d])[np.triu_indices(d)])
    return {d: Fit(v[-1], v[:-1], centres[d], second[d], components) for d, v in first.items()}


def _values(rows: DataFrame, fitted: dict[int, Fit], scale: int, shift: int) -> DataFrame:
    """vec_id, dim, deviation, whitened (array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, (own, x) in _entries(b.column(1), scale, shift).items():
                white, deviation = fitted[d].whitened(x)
                k = white.shape[1]
                flat = pa.array(white.ravel(), mask=np.isnan(white).ravel())
                arrays = [b.column(0).take(pa.array(own)), pa.array([d] * len(own), pa.int32()), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * k, pa.int32()), flat)]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "dim", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, dim int, deviation bigint, whitened array<double>")


def identity_errors(rows: DataFrame, fitted: dict[int, Fit], scale: int = SCALE, shift: int = SHIFT) -> dict[int, float | None]:
    """Per length the largest absolute entry of the whitened values' covariance less the identity.

    Values are centred by their mean, found in one pass, before they are multiplied in the next.
    """
    usable = {d: np.flatnonzero(f.values > 0) for d, f in fitted.items()}

    def summed(per_block) -> dict[int, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for d, (_, x) in _entries(b.column(0), scale, shift).items():
                    for i in range(0, len(x), _ROWS):
                        own = per_block(d, fitted[d].whitened(x[i : i + _ROWS])[0][:, usable[d]])
                        total[d] = own + total.get(d, 0.0)
            for d, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(v), pa.int32()), pa.array(np.arange(len(v)), pa.int64()), pa.array(v)], ["dim", "at", "part"])

        parts = rows.select("embedding").mapInArrow(run, "dim int, at bigint, part double")
        out: dict[int, list[float]] = {}
        for r in parts.groupBy("dim", "at").agg(F.sum("part").alias("total")).orderBy("dim", "at").collect():
            out.setdefault(r.dim, []).append(r.total)
        return {d: np.array(v) for d, v in out.items()}

    means = {d: v / fitted[d].n for d, v in summed(lambda d, w: w.sum(0)).items()}
    empty = np.zeros(0)
    products = summed(lambda d, w: ((w - means.get(d, empty)).T @ (w - means.get(d, empty))).ravel())
    errors: dict[int, float | None] = dict.fromkeys(fitted)
    for d, v in products.items():
        k = len(usable[d])
        errors[d] = float(np.abs(v.reshape(k, k) / fitted[d].n - np.eye(k)).max())
    return errors


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of all usable rows of (vec_id, embedding)."""
    spark: SparkSession = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    fitted = fits(rows, components, scale, shift)
    if not fitted:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    errors = identity_errors(rows, fitted, scale, shift)
    # one row per length and component, at most DIMENSIONS lengths
    facts = reduce(DataFrame.unionAll, [spark.createDataFrame([(d, f.n, [float(x) for x in f.explained], errors[d])], "dim int, n bigint, explained array<double>, identity_error double") for d, f in fitted.items()])
    values = _values(rows, fitted, scale, shift).join(F.broadcast(facts), "dim")
    each = values.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error")
