"""Voxels gathered by blocks with a one-voxel halo, so that neighbours are read from arrays.

A voxel goes to its own block and to those next to it that see it in their halo: with blocks of eight an
inner voxel travels once, and 1.4 to 2 rows travel per voxel on average. One shuffle brings the blocks together, rows arrive
sorted by block, and a batch of whole blocks is scattered into one array in which the neighbour of a voxel
is a fixed number of places away. A block is never more than (8 + 2)^3 rows, whatever the field holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.grid import IJK, block_key
from ..session import task_slots

DIM = 8
_SIDE = DIM + 2
#: Places between neighbours along x, y and z in the scattered array.
STRIDES = (1, _SIDE, _SIDE * _SIDE)
# Blocks that are scattered at once.
_AT_ONCE = 128
_BLOCK = ["_b0", "_b1", "_b2"]
# Bits that stand for no value where doubles are held as integers: a NaN that no computation gives, so that a stored NaN stays one.
_MISSING = np.int64(0x7FF8_0000_6D69_7373)


def _dealt_rows(voxels: DataFrame, seen: str, values: list[str]) -> DataFrame:
    """Rows ``_b0 _b1 _b2, _at, _own`` and all columns, the ones beside key and values null on halo rows.

    ``seen`` tells who sees a voxel: ``faces``, the neighbours that share a face, or ``upper``, all those that have it as the
    upper corner of a cell.
    """
    d = voxels
    for n, axis in enumerate(IJK):
        place = F.pmod(F.col(axis).cast("bigint"), F.lit(DIM))
        low = F.array(F.lit(0), F.lit(-1))
        steps = F.when(place == 0, low)
        if seen == "faces":
            steps = steps.when(place == DIM - 1, F.array(F.lit(0), F.lit(1)))
        d = d.withColumn(f"_o{n}", F.explode(steps.otherwise(F.array(F.lit(0)))))
    if seen == "faces":
        d = d.where("abs(_o0) + abs(_o1) + abs(_o2) <= 1")
    own = (F.col("_o0") == 0) & (F.col("_o1") == 0) & (F.col("_o2") == 0)
    at = F.lit(0)
    out = {}
    for n, axis in enumerate(IJK):
        i = F.col(axis).cast("bigint")
        out[f"_b{n}"] = F.floor(i / DIM) + F.col(f"_o{n}")
        at = at + (F.pmod(i, F.lit(DIM)) - F.col(f"_o{n}") * DIM + 1) * STRIDES[n]
    rest = [F.when(own, F.col(c)).alias(c) for c in voxels.columns if c not in ("field_id", *values)]
    return d.select("field_id", *[c.alias(n) for n, c in out.items()], at.cast("int").alias("_at"), own.alias("_own"), *values, *rest)


def _dealt(voxels: DataFrame, seen: str, values: list[str], buckets: int | None = None) -> DataFrame:
    """The rows of :func:`_dealt_rows`, whole blocks together and in order."""
    d = _dealt_rows(voxels, seen, values)
    key = ["field_id", *_BLOCK]
    if buckets is None:
        dealt = d.repartition(task_slots(voxels.sparkSession), *key)
    else:
        dealt = d.repartition(buckets, "field_id", block_key([F.col(b) for b in _BLOCK]))
    return dealt.sortWithinPartitions(*key)


def over_blocks(voxels: DataFrame, seen: str, values: list[str], make: Callable, schema: str, buckets: int | None = None) -> DataFrame:
    """Rows that ``make`` gives for the voxels of all blocks.

    ``make`` gets the rows of the voxels themselves as an Arrow batch, their places, and one array per
    name in ``values``, NaN where there is no voxel; it returns a batch of ``schema``. Null values count as missing.
    With ``buckets`` the blocks are dealt to so many partitions, as a table bucketed by field and block deals them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks_of(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            group = np.zeros(rows.num_rows, np.int64)
            group[starts[1:]] = 1
            np.cumsum(group, out=group)
            own = np.asarray(rows.column("_own"))
            # blocks that hold halo rows only are not stored
            full = np.flatnonzero(np.bincount(group[own], minlength=len(starts)))
            number = np.full(len(starts), -1)
            number[full] = np.arange(len(full))
            number = number[group]
            at, given = np.asarray(rows.column("_at")), [np.asarray(pc.fill_null(rows.column(c).cast(pa.float64()), np.nan)) for c in values]
            for lo in range(0, len(full), _AT_ONCE):
                mine = np.flatnonzero((number >= lo) & (number < lo + _AT_ONCE))
                flat = (number[mine] - lo) * _SIDE**3 + at[mine]
                arrays = []
                for v in given:
                    a = np.full(min(_AT_ONCE, len(full) - lo) * _SIDE**3, np.nan)
                    a[flat] = v[mine]
                    arrays.append(a)
                self_rows = own[mine]
                yield make(rows.take(pa.array(mine[self_rows])), flat[self_rows], arrays)

        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for c in ("field_id", *_BLOCK):
                x = b.column(c)
                change[1:] |= np.asarray(pc.not_equal(x[1:], x[:-1]))
            if held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in ("field_id", *_BLOCK)):
                change[0] = True
            cuts = np.flatnonzero(change)
            if not len(cuts):
                held.append(b)
                continue
            last = int(cuts[-1])
            whole = _joined([*held, b.slice(0, last)])
            if whole.num_rows:
                before = sum(h.num_rows for h in held)
                starts = np.unique(np.concatenate([[0], cuts[:-1] + before]))
                yield from blocks_of(whole, starts)
            held = [b.slice(last)]
        if held:
            whole = _joined(held)
            change = np.zeros(whole.num_rows, bool)
            for c in ("field_id", *_BLOCK):
                x = whole.column(c)
                change[1:] |= np.asarray(pc.not_equal(x[1:], x[:-1]))
            yield from blocks_of(whole, np.flatnonzero(change | (np.arange(whole.num_rows) == 0)))

    return _dealt(voxels, seen, values, buckets).mapInArrow(run, schema)


def _marked(points: DataFrame, apart: Column) -> DataFrame:
    """Points as rows that can stand beside the dealt voxels: block and place of ``_i _j _k``, the row itself as ``_row``.

    Points that are ``apart`` read nothing; they get blocks of their own by hash, so that many of one unknown field don't share a task.
    """
    own = F.struct(*points.columns)
    idx = [F.col(f"_{n}") for n in IJK]
    off = F.lit(-(1 << 40)) - F.pmod(F.xxhash64(own), F.lit(1 << 12))
    at = sum(((F.pmod(i, F.lit(DIM)) + 1) * s for i, s in zip(idx, STRIDES)), F.lit(0))
    blocks = {f"_b{n}": F.when(apart, off).otherwise(F.floor(i / DIM)) for n, i in enumerate(idx)}
    return points.select("field_id", *[c.cast("bigint").alias(b) for b, c in blocks.items()], at.cast("int").alias("_at"), own.alias("_row"))


def read_points(
    points: DataFrame, apart: Column, voxels: DataFrame, values: list[str], reads: dict[str, tuple], kept: list[str], fold: Callable, folded: list[str]
) -> DataFrame:
    """``points`` with the values of voxels around them, NULL where there is no voxel.

    ``points`` hold ``field_id`` and the index ``_i _j _k`` of the lower corner of their cell. ``reads`` names the new columns,
    each a value and an offset of 0 or 1 per axis from that corner, or the name of a point's column that holds the offset as places (see ``STRIDES``).
    Of these the ``kept`` ones come out, and the ``folded`` ones that ``fold`` makes, a batch at a time, of the points as a
    struct array, the values by name and where they are known: per name an array and where it holds.
    Voxels and points are dealt by block, the voxels of a block first, and a point reads from the array of its block: one
    shuffle of 1.4 rows per voxel and one row per point, and a point's eight corners never become rows.
    """
    key = ["field_id", *_BLOCK]
    plan = [(name, values.index(c), where if isinstance(where, str) else sum(o * s for o, s in zip(where, STRIDES))) for name, (c, where) in reads.items()]
    names = points.columns
    size = _SIDE**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            for c in key:
                x = b.column(c)
                # a NULL field is equal to none
                change[1:] |= np.asarray(pc.fill_null(pc.not_equal(x[1:], x[:-1]), True))
            goes_on = last is not None and all(last[c] is not None and last[c] == b.column(c)[0].as_py() for c in key)
            last = {c: b.column(c)[n - 1].as_py() for c in key}
            group = np.cumsum(change)
            at, asks = np.asarray(b.column("_at")), np.asarray(b.column("_row").is_valid())
            given = np.flatnonzero(~asks)
            mine = np.flatnonzero(asks)
            rows = b.column("_row").take(pa.array(mine)) if len(mine) else None
            steps = {w: np.asarray(rows.field(w)) for _, _, w in plan if isinstance(w, str)} if rows is not None else {}
            bits = [np.asarray(pc.fill_null(b.column(c), np.nan)).view(np.int64) for c in values]
            bits = [np.where(np.asarray(b.column(c).is_valid()), x, _MISSING) for c, x in zip(values, bits, strict=True)]
            out = np.full((len(plan), len(mine)), _MISSING)
            # groups with voxels, the one that goes on from the last batch among them
            full = np.unique(np.concatenate([group[given], np.zeros(int(goes_on and held is not None), group.dtype)]))
            place = np.full(int(group[-1]) + 1, -1)
            place[full] = np.arange(len(full))
            before, held = held if goes_on else None, None
            vp, pp = place[group[given]], place[group[mine]]
            for lo in range(0, len(full), _AT_ONCE):
                block = np.full((min(_AT_ONCE, len(full) - lo), len(values) * size), _MISSING)
                if lo == 0 and before is not None:
                    block[0] = before
                v = slice(*np.searchsorted(vp, [lo, lo + _AT_ONCE]))
                for k, x in enumerate(bits):
                    block[vp[v] - lo, k * size + at[given[v]]] = x[given[v]]
                q = np.flatnonzero((pp >= lo) & (pp < lo + _AT_ONCE))
                for r, (_, k, where) in enumerate(plan):
                    out[r, q] = block[pp[q] - lo, k * size + at[mine[q]] + (steps[where][q] if isinstance(where, str) else where)]
                if full[min(lo + _AT_ONCE, len(full)) - 1] == group[-1]:
                    held = block[-1].copy()
            if rows is not None:
                known = {name: x != _MISSING for (name, _, _), x in zip(plan, out, strict=True)}
                got = {name: x.view(np.float64) for (name, _, _), x in zip(plan, out, strict=True)}
                found = [(got[c], known[c]) for c in kept] + fold(rows, got, known)
                yield pa.RecordBatch.from_arrays([*rows.flatten(), *(pa.array(x, mask=~ok) for x, ok in found)], [*names, *kept, *folded])

    v = _dealt_rows(voxels, "upper", values).select(*key, "_at", *values)
    both = v.unionByName(_marked(points, apart), allowMissingColumns=True)
    both = both.repartition(task_slots(voxels.sparkSession), *key).sortWithinPartitions(*key, F.col("_row").isNotNull())
    schema = StructType([*points.schema.fields, *(StructField(name, DoubleType()) for name in (*kept, *folded))])
    return both.mapInArrow(run, schema)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]
