"""Exact substring de-duplication with suffix arrays.

Every byte covered by a ``window``-byte string that also starts anywhere else, in the same text or
another, is removed; strings are judged on the input. Equal windows must meet in one task, without
gathering the corpus. Every window is filed under its anchor: the position whose hash of ``GRAM``
bytes is the smallest in the window (the first of equals), so equal windows have equal anchors.
The windows of a text that share an anchor position form one segment. Tasks pass on the digests of
segments; segments with the same bytes collapse to one, and an anchor with a single segment is
done. Only distinct segments that share their anchor's hash travel as bytes, packed into groups of
about ``GROUP_BYTES``. There a suffix array is built by two-stage sorting, and windows whose common
prefix with a neighbour reaches the window length are repeated.

An anchor whose distinct segments exceed ``HOT_BYTES`` would not fit a task; the digests of its
single windows are counted instead, spread over all tasks, with the same result.

Defined results: null or empty text has nothing to remove; a text shorter than the window neither;
equal rows repeat each other in full; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mix, powers, ranges, text_blocks, value_table
from .common import staged
from .suffixarray import repeated_starts

WINDOW = 400
GRAM = 128
GROUP_BYTES = 1 << 20
HOT_BYTES = 6 << 20
# A staged table with at most so many bytes goes to the other side; beyond, both are shuffled.
BROADCAST_BYTES = 32 << 20


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For every window start the position of its anchor, and the hash at every position."""
    n = len(data)
    with np.errstate(over="ignore"):
        h = value_table(21)[data]
        size = 1
        while size < gram:
            h = h[:-size] * np.uint64(0xD1342543DE82EF95) + h[size:] if len(h) > size else h[:0]
            h ^= h >> np.uint64(29)
            size *= 2
        h = mix(h)
    if n < window:
        return np.zeros(0, np.int64), h
    bits = np.uint64(max(int(len(h)).bit_length(), 1))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), h


def segments(data: np.ndarray, offs: np.ndarray, window: int = WINDOW):
    """Runs of windows with one anchor position: text number, first start, number of windows, anchor hash."""
    at, h = anchors(data, window)
    n = len(at)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    row = np.searchsorted(offs, np.arange(n), "right") - 1
    inside = np.arange(n) + window <= offs[row + 1]
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    closed = np.ones(n + 1, bool)  # where a run can't go on
    closed[:-1] = new | ~inside
    ends = np.flatnonzero(closed)
    count = ends[np.searchsorted(ends, first, "right")] - first
    return row[first], first, count, h[at[first]]


def _digest(b: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(b, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


KEY = ["k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """Every row with its text (nulls empty), two 64-bit keys of the text, and one of the id."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"text": text, "k1": F.xxhash64(F.lit(1), text), "k2": F.xxhash64(F.lit(2), text)})


def _lighter(df: DataFrame, row_bytes: int) -> DataFrame:
    """A staged table with a hint to broadcast it where its rows prove to be few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _occurrences(texts: DataFrame, window: int) -> DataFrame:
    """All segments: keys of the text and of the row, start in the text, windows, anchor, digest d1, d2."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(3)):
                row, first, count, anchor = segments(data, offs, window)
                raw = data.tobytes()
                d = np.array([_digest(raw[s : s + c + window - 1]) for s, c in zip(first.tolist(), count.tolist(), strict=True)], np.int64).reshape(-1, 2)
                keys = [b.column(i)[lo:hi].take(pa.array(row)) for i in range(3)]
                start = pa.array(first - offs[row], pa.int64())
                whole = pa.RecordBatch.from_arrays([*keys, start, pa.array(count, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1])], ["k1", "k2", "who", "start", "windows", "anchor", "d1", "d2"])
                for i in range(0, whole.num_rows, 50_000):
                    yield whole.slice(i, 50_000)

    return texts.select("k1", "k2", "who", "text").mapInArrow(run, "k1 bigint, k2 bigint, who bigint, start bigint, windows int, anchor bigint, d1 bigint, d2 bigint")


def _cut_out(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(pile, anchor, d1, d2, windows, bytes) of the wanted segments, from the row that each names."""
    lists = wanted.groupBy("k1", "k2", "who").agg(F.collect_list(F.struct("start", "pile", "anchor", "d1", "d2", "windows")).alias("cuts"))
    got = texts.select("k1", "k2", "who", "text").join(lists, ["k1", "k2", "who"]).select("text", "cuts")

    def run(batches):
        for b in batches:
            for text, cuts in zip(b.column(0), b.column(1), strict=True):
                raw, rows = text.as_buffer(), cuts.as_py()
                view = memoryview(raw)
                cols = [[r[c] for r in rows] for c in ("pile", "anchor", "d1", "d2", "windows")]
                own = [bytes(view[r["start"] : r["start"] + r["windows"] + window - 1]) for r in rows]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(own, pa.binary())], ["pile", "anchor", "d1", "d2", "windows", "bytes"])

    return got.mapInArrow(run, "pile bigint, anchor bigint, d1 bigint, d2 bigint, windows bigint, bytes binary")


_FOUND = "d1 bigint, d2 bigint, runs array<struct<a:int,b:int>>"


def _runs_batch(d1, d2, owner: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Per segment (owner) its repeated window starts as runs [a, b)."""
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    who, group = np.unique(owner[first], return_index=True)
    offs = np.append(group, len(first)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(at[first], pa.int32()), pa.array(at[last] + 1, pa.int32())], ["a", "b"])
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(d1)[who], pa.int64()), pa.array(np.asarray(d2)[who], pa.int64()), pa.ListArray.from_arrays(offs, runs)], ["d1", "d2", "runs"])


def _by_suffix_array(pile: pa.Table, window: int) -> pa.RecordBatch:
    """Repeated windows among the distinct segments of one pile."""
    pile = pile.select(["d1", "d2", "bytes"])
    d1, d2 = pile.column(0).to_numpy(), pile.column(1).to_numpy()
    _, one = np.unique(np.stack([d1, d2], 1), axis=0, return_index=True)
    pieces = [pile.column(2)[int(i)].as_buffer() for i in one]
    # a byte that UTF-8 never has stands between segments, so no common prefix crosses it
    text = np.frombuffer(b"\xff".join(pieces), np.uint8)
    lens = np.array([len(p) for p in pieces])
    begin = np.cumsum(lens + 1) - (lens + 1)
    allowed = np.zeros(len(text), bool)
    allowed[ranges(begin, lens - window + 1)] = True
    hit = repeated_starts(text, allowed, window)
    owner = np.searchsorted(begin, hit, "right") - 1
    return _runs_batch(d1[one], d2[one], owner, hit - begin[owner])


def window_digests(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of a byte string."""
    n = len(data) - window + 1
    out = []
    with np.errstate(over="ignore"):
        # dividing by the power of the start makes equal windows equal wherever they stand
        back = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))
        shift = np.full(n, back, np.uint64)
        shift[0] = 1
        shift = np.multiply.accumulate(shift)
        for seed in (31, 32):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(value_table(seed)[data] * powers(len(data))[: len(data)], out=total[1:])
            out.append(mix((total[window:] - total[:n]) * shift))
    return out[0], out[1]


def _by_digests(hot: DataFrame, parts: int, window: int) -> DataFrame:
    """Repeated windows of segments whose anchor has too many of them: windows counted by digest."""

    def split(batches):
        for b in batches:
            cols = []
            for d1, d2, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(5), strict=True):
                x, y = window_digests(np.frombuffer(raw.as_buffer(), np.uint8), window)
                cols.append(np.stack([x.view(np.int64), y.view(np.int64), np.full(len(x), d1), np.full(len(x), d2), np.arange(len(x))], 1))
            if not cols:
                continue
            cols = np.concatenate(cols)
            part = (cols[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, at = np.unique(part[order], return_index=True)
            blocks = [np.ascontiguousarray(x).tobytes() for x in np.split(cols[order], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(blocks, pa.binary())], ["part", "rows"])

    def count(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.int64).reshape(-1, 5)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        same = (rows[1:, :2] == rows[:-1, :2]).all(1)
        hit = np.zeros(len(rows), bool)
        hit[1:] |= same
        hit[:-1] |= same
        rows = rows[hit]
        seg, owner = np.unique(rows[:, 2:4], axis=0, return_inverse=True)
        return pa.Table.from_batches([_runs_batch(seg[:, 0], seg[:, 1], owner.ravel(), rows[:, 4])])

    return hot.mapInArrow(split, "part bigint, rows binary").groupBy("part").applyInArrow(count, _FOUND)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, spans): per distinct text with any, the byte ranges [a, b) that repeated windows cover."""
    texts = keyed(docs.select("text", F.xxhash64("doc_id").alias("who")))
    every = staged(_occurrences(texts, window))
    shared = staged(every.groupBy("anchor").agg(F.count("d1").alias("n"), (F.min("d1") != F.max("d1")).alias("varied")).where("n > 1").select("anchor", "varied"))
    some = staged(every.join(_lighter(shared, 24), "anchor"))
    distinct = staged(some.groupBy("anchor", "d1", "d2").agg(F.count("start").alias("n"), F.first("windows").alias("windows"), F.first("varied").alias("varied"), F.min(F.struct("k1", "k2", "who", "start")).alias("at")))
    # all windows of a segment that occurs twice are repeated
    whole = distinct.where("n > 1").select("d1", "d2", F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b"))).alias("runs"))
    weight = F.sum(F.col("windows") + (window - 1))
    piles = distinct.where("varied").groupBy("anchor").agg(weight.alias("bytes"))
    total, hot_total = piles.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.expr(f"if(bytes > {HOT_BYTES}, bytes, 0)")), F.lit(0))).first()
    n_piles = max(1, math.ceil(total / GROUP_BYTES))
    pile = F.expr(f"if(bytes > {HOT_BYTES}, -1, pmod(xxhash64(anchor), {n_piles}))")
    sized = staged(piles.select("anchor", pile.alias("pile")))
    wanted = staged(distinct.where("varied").join(_lighter(sized, 24), "anchor").select("at.*", "pile", "anchor", "d1", "d2", "windows"))
    bytes_of = _cut_out(texts, wanted, window)
    if hot_total:
        bytes_of = staged(bytes_of)
    found = bytes_of.where("pile >= 0").groupBy("pile").applyInArrow(lambda t: pa.Table.from_batches([_by_suffix_array(t, window)]), _FOUND)
    if hot_total:
        parts = max(1, math.ceil(hot_total * 40 / (16 << 20)))
        found = found.unionByName(_by_digests(bytes_of.where("pile < 0"), parts, window))
    runs = staged(found.unionByName(whole))
    occurrence = some.groupBy("k1", "k2", "start").agg(F.first("d1").alias("d1"), F.first("d2").alias("d2"))
    spans = occurrence.join(runs, ["d1", "d2"]).select("k1", "k2", F.expr("transform(runs, r -> struct(start + r.a as a, start + r.b as b))").alias("runs"))
    return staged(spans.groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("spans")))


def _merged(runs: list, window: int) -> list[tuple[int, int]]:
    """Runs [a, b) of repeated starts, sorted, to maximal covered byte ranges."""
    out: list[list[int]] = []
    for r in runs or []:
        a, b = r["a"], r["b"] + window - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    return keyed(docs).join(repeated_windows(docs, window), KEY, "left")


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept_sha256 of every row."""
    wide = _with_spans(docs.select("doc_id", "text"), window).select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            cols = [[], [], [], [], []]
            for text, runs in zip(b.column(1), b.column(2), strict=True):
                raw = bytes(text.as_buffer())
                spans = _merged(runs.as_py(), window)
                for c, x in zip(cols, (len(raw), sum(e - s for s, e in spans), len(spans), [{"a": s, "b": e} for s, e in spans], hashlib.sha256(_kept(raw, spans)).hexdigest()), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return wide.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<a:bigint,b:bigint>>, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows with repeated bytes taken out of ``text``; ``n_chars``, where there, follows.

    A character that a removed range cuts through goes as a whole; a null text comes back empty. All
    other columns stay.
    """
    names = docs.columns
    others = [n for n in names if n != "text"]
    wide = _with_spans(docs.select(F.struct(*others).alias("row"), "doc_id", "text"), window).select("row", "text", "spans")

    def run(batches):
        for b in batches:
            kept, changed = [], b.column(2).is_valid().to_pylist()
            for text, runs, c in zip(b.column(1), b.column(2), changed, strict=True):
                kept.append(_kept(bytes(text.as_buffer()), _merged(runs.as_py(), window)).decode("utf-8", "ignore") if c else text.as_py())
            fields = dict(zip(others, b.column(0).flatten(), strict=True))
            fields["text"] = pa.array(kept, pa.string())
            if "n_chars" in fields:
                was = fields["n_chars"]
                fields["n_chars"] = pa.array([len(k) if c else o for k, c, o in zip(kept, changed, was.to_pylist(), strict=True)], was.type)
            yield pa.RecordBatch.from_arrays([fields[n] for n in names], names)

    return wide.mapInArrow(run, docs.schema)
