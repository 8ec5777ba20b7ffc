"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There a plan
is made over counts: for every length from the longest down, the gap it leaves is looked up among
single lengths, sums of two and sums of three lengths, and combinations that fill it exactly are
consumed as often as the counts of their lengths allow; what has no exact complement is placed best
fit, longest first, also over counts. Every step uses up a length or a group of equal sequences, so
the plan has a few entries per length, however many pieces there are.

Every task numbers the pieces it cuts per length; with the sums over tasks that gives each piece
its rank among all pieces of its length, and the plan tells which ranks go where. No group is
sorted or gathered, also if one length has most of the pieces.

Defined results: null or empty text is one piece with the end id alone; equal rows are packed one
by one; a null id is carried; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .blocks import text_blocks
from .bpe import BLOCK_BYTES, vocabulary
from .common import staged

CAPACITY = 2048
END_ID = 0


def _with_special(ids: np.ndarray, rows: np.ndarray, data: np.ndarray, offs: np.ndarray, path: str) -> list[np.ndarray]:
    """Ids per text; texts that spell out a special token go through the tokenizer's own splitting."""
    out = np.split(ids, rows[1:-1])
    raw = data.tobytes()
    if b"<|" in raw:
        library = Tokenizer.from_file(path)
        names = [t.content.encode() for t in library.get_added_tokens_decoder().values()]
        for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
            if any(n in raw[a:b] for n in names):
                out[i] = np.array(library.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.int64)
    return out


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every text: doc_id, piece, start, length, ids_crc32, task, ordinal (and ids).

    The end id is the last token of a text. A longer text is cut into full pieces from its end, so
    its first piece takes the rest. ``ordinal`` counts the pieces of a length within a task.
    """

    def run(batches):
        vocab = vocabulary(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(1), BLOCK_BYTES):
                own, rows = vocab.encode(data, offs)
                cols = defaultdict(list)
                for i, ids in enumerate(_with_special(own, rows, data, offs, path)):
                    ids = np.append(ids, END_ID).astype("<u4")
                    first = len(ids) % capacity or capacity
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        cols["row"].append(lo + i)
                        cols["piece"].append(k)
                        cols["start"].append(s)
                        cols["length"].append(e - s)
                        cols["crc"].append(zlib.crc32(ids[s:e].tobytes()))
                        cols["ordinal"].append(seen[e - s])
                        seen[e - s] += 1
                        if with_ids:
                            cols["ids"].append(ids[s:e].astype(np.int32))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "ordinal"] + ["ids"] * with_ids
                arrays = [b.column(0).take(pa.array(cols["row"])), pa.array(cols["piece"], pa.int32()), pa.array(cols["start"], pa.int64()), pa.array(cols["length"], pa.int64()), pa.array(cols["crc"], pa.int64()), pa.array([task] * len(cols["row"]), pa.int32()), pa.array(cols["ordinal"], pa.int64())]
                if with_ids:
                    arrays.append(pa.array(cols["ids"], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, ordinal bigint{ids}")


def _complement(free: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that add up to the gap, the longest first; None if there are none.

    ``free`` is the availability by length: it is the index of single sums, and read against itself
    backwards it is the index of pair sums; a triple is a single with a pair behind it.
    """
    if free[gap]:
        return (gap,)

    def pair(total: int, most: int):
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        ok = (free[a] > 0) & (free[total - a] > 0) & ((2 * a != total) | (free[a] > 1))
        return (int(a[ok.argmax()]), int(total - a[ok.argmax()])) if ok.any() else None

    if found := pair(gap, gap):
        return found
    for a in np.flatnonzero(free[: gap - 1])[::-1]:
        free[a] -= 1
        found = pair(gap - int(a), int(a)) if 3 * a >= gap else None
        free[a] += 1
        if found:
            return (int(a), *found)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); the lengths used are exactly ``counts``."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    made: list[tuple[tuple[int, ...], int]] = []
    rest: dict[int, int] = {}
    for length in range(capacity, 0, -1):
        while free[length]:
            gap = capacity - length
            free[length] -= 1  # one of them leads, so a complement can't count it again
            found = _complement(free, gap) if gap else ()
            free[length] += 1
            if found is None:
                rest[length] = int(free[length])
                free[length] = 0
                break
            shape = (length, *found)
            times = min(int(free[x]) // shape.count(x) for x in shape)
            for x in shape:
                free[x] -= times
            made.append((shape, times))
    open_: dict[int, list[list]] = defaultdict(list)  # by gap: [shape, how many]
    for length, n in rest.items():
        while n:
            fits = [g for g, groups in open_.items() if g >= length and groups]
            if fits:
                gap = min(fits)
                shape, have = open_[gap].pop()
                times = min(n, have)
                if have > times:
                    open_[gap].append([shape, have - times])
                open_[gap - length].append([(*shape, length), times])
                n -= times
            else:
                each = capacity // length
                if n >= each:
                    open_[capacity - each * length].append([(length,) * each, n // each])
                if n % each:
                    open_[capacity - n % each * length].append([(length,) * (n % each), 1])
                n = 0
    return made + [(s, n) for groups in open_.values() for s, n in groups]


class _Places:
    """The plan as sorted arrays: rank of a piece among its length to sequence and offset."""

    def __init__(self, shapes: list[tuple[tuple[int, ...], int]]):
        ranked: dict[int, int] = defaultdict(int)
        rows, first = [], 0
        for shape, times in shapes:
            offset = 0
            for length in shape:
                rows.append((length, ranked[length], first, offset))
                ranked[length] += times
                offset += length
            first += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.lengths, self.ranks, self.first, self.offset = table.T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64(1) << 44
        at = np.searchsorted(self.lengths * wide + self.ranks, length * wide + rank, "right") - 1
        return self.first[at] + rank - self.ranks[at], self.offset[at]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = staged(cut(docs, path, capacity, with_ids))
    per_task = pieces.groupBy("task", "length").count()
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(_Places(plan(counts, capacity)))
    before = per_task.select("task", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")).alias("before"))
    columns = [c for c in pieces.columns if c not in ("task", "ordinal")]
    ranked = pieces.join(before, ["task", "length"]).select(*columns, (F.col("before") + F.col("ordinal")).alias("rank"))
    at = ranked.columns.index("length")

    def run(batches):
        for b in batches:
            seq, offset = places.value.find(b.column(at).to_numpy(), b.column(b.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids, doc_ids in order.

    A sequence holds ``capacity`` ids at most, which bounds every group.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
