"""Hard negatives by a box tree per shard.

Rows are numbered once, dealt to shards by a hash of the number, and every shard packs its own tree
(``boxtree.py``) in one task, which is staged. Anchors are a small part of the rows; every block of
``ANCHORS`` of them asks every shard, first for the nearest rows of the same label, then, with the
windows that those positives set, for rows of other labels. A shard answers with its first few hits
per question, and the answers of all shards are ranked together, so a question never meets more
than shards times k rows. Trees travel once per block of anchors, anchors once per shard, both in
the narrowest integers that hold them.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part, nor do vectors with a component too large for inner products of 64 bits; vectors of different
lengths are never compared; an empty vector has inner product 0 with another; repeated rows are
rows of their own, so a copy of an anchor is another row and an anchor that is there twice answers
twice; a null id sorts behind all others; an anchor without positives, and a positive without
negatives, give no rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boxtree
from .common import staged

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# Least and largest negative score, in hundredths of the positive's.
LEAST, MOST = 30, 90
SHARDS = 16
SHARD_BYTES = 32 << 20
ANCHORS = 65_536
# Questions that share a queue.
_BLOCK = 512


def _narrow(values: np.ndarray) -> np.ndarray:
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    return values.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def scaled(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, dim, vec: floor(scale * x) of every component as little-endian integers of 2, 4 or 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2)
            offs = np.asarray(vectors.offsets)
            flat = vectors.values
            bad = np.asarray(flat.is_null())
            x = np.asarray(flat.cast(pa.float64()).fill_null(0.0))
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
            lens = np.diff(offs)
            # sums of products stay below 2^63
            bound = np.sqrt(2.0**63 / np.maximum(np.repeat(lens, lens), 1)) - 1 if len(lens) else np.zeros(0)
            inside = x[offs[0] : offs[-1]] if len(offs) else x
            wrong = bad[offs[0] : offs[-1]] | ~(np.abs(inside) <= bound)
            count = np.zeros(len(wrong) + 1, np.int64)
            np.cumsum(wrong, out=count[1:])
            at = offs - offs[0]
            keep = np.asarray(vectors.is_valid()) & np.asarray(b.column(1).is_valid()) & (count[at[1:]] == count[at[:-1]])
            chosen = np.flatnonzero(keep)
            packed = [_narrow(inside[at[i] : at[i + 1]]).tobytes() for i in chosen]
            take = pa.array(chosen)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(lens[chosen], pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "label", "dim", "vec"])

    return rows.select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding").mapInArrow(run, "vec_id bigint, label bigint, dim int, vec binary")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    own = column.to_pylist()
    if not dim:
        return np.zeros((len(own), 0), np.int16)
    widths = {len(v) // dim for v in own}
    if len(widths) == 1:
        return np.frombuffer(b"".join(own), f"<i{widths.pop()}").reshape(-1, dim)
    out = np.empty((len(own), dim), np.int64)
    for i, v in enumerate(own):
        out[i] = np.frombuffer(v, f"<i{len(v) // dim}")
    return out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).max).to_numpy()


def _grown(shard: pa.Table) -> pa.Table:
    dim = shard.column("dim")[0].as_py()
    tree = boxtree.build(_matrix(shard.column("vec"), dim), shard.column("label").to_numpy(), _ids(shard.column("vec_id")), shard.column("uid").to_numpy())
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": shard.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})


_FOUND = "anchor bigint, bound bigint, score bigint, hit bigint, hit_id bigint"


def _asked(trees: pa.Table, anchors: pa.Table, k: int, same: bool) -> pa.Table:
    """First ``k`` hits of one shard per anchor, and per window if windows are given: all fields of ``_FOUND``."""
    schema = pa.schema([(f.split()[0], pa.int64()) for f in _FOUND.split(", ")])
    if not trees.num_rows or not anchors.num_rows:
        return schema.empty_table()
    tree = pickle.loads(trees.column("tree")[0].as_py())
    vec, label, uid = _matrix(anchors.column("vec"), anchors.column("dim")[0].as_py()), anchors.column("label").to_numpy(), anchors.column("uid").to_numpy()
    info = np.iinfo(np.int64)
    if same:
        who, bound = np.arange(len(uid)), np.zeros(len(uid), np.int64)
        low, high = np.full(len(uid), info.min + 1), np.full(len(uid), info.max)
    else:
        bounds = anchors.column("bounds").combine_chunks()
        who, bound = np.repeat(np.arange(len(uid)), np.diff(np.asarray(bounds.offsets))), bounds.flatten().to_numpy()
        low, high = -(-LEAST * bound // 100), MOST * bound // 100
        if (np.abs(bound) > info.max // 100).any():  # beyond 64 bits, one by one
            low = np.array([-(-LEAST * int(x) // 100) for x in bound], np.int64)
            high = np.array([MOST * int(x) // 100 for x in bound], np.int64)
    parts = []
    for i in range(0, len(who), _BLOCK):
        w, b = who[i : i + _BLOCK], bound[i : i + _BLOCK]
        top = boxtree.search(tree, vec[w], label[w], uid[w], low[i : i + _BLOCK], high[i : i + _BLOCK], k, same)
        q, r = np.nonzero(top.row >= 0)
        row = top.row[q, r]
        parts.append(np.stack([uid[w[q]], b[q], top.score[q, r], tree.uids[row], tree.ids[row]], 1))
    found = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
    named = [pa.array(found[:, j]) for j in range(4)] + [pa.array(found[:, 4], mask=found[:, 4] == info.max)]
    return pa.table(named, schema=schema)


def mine(rows: DataFrame, anchor: Column | str, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, shards: int = SHARDS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all rows of (vec_id, label, embedding).

    ``anchor`` is a condition on ``vec_id`` that tells which rows are anchors.
    """
    all_rows = staged(scaled(rows, scale).withColumn("uid", F.monotonically_increasing_id()))
    total, size = all_rows.agg(F.count("uid"), F.coalesce(F.sum(F.length("vec") + 24), F.lit(0))).first()
    shards = max(shards, -(-size // SHARD_BYTES))
    trees = staged(all_rows.withColumn("shard", F.expr(f"pmod(xxhash64(uid), {shards})")).groupBy("dim", "shard").applyInArrow(_grown, "dim int, shard bigint, tree binary"))
    condition = F.expr(anchor) if isinstance(anchor, str) else anchor
    anchors = staged(all_rows.where(condition))
    blocks = max(1, -(-anchors.count() // ANCHORS))
    block = F.expr(f"pmod(xxhash64(uid, 'block'), {blocks})").alias("block")

    def numbered(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    def ask(questions: DataFrame, k: int, same: bool) -> DataFrame:
        """The first ``k`` hits per (anchor, bound) over all shards, with their rank."""
        left = trees.withColumn("block", numbered(blocks)).groupBy("dim", "shard", "block")
        right = questions.select("*", block).withColumn("shard", numbered(shards)).groupBy("dim", "shard", "block")
        found = left.cogroup(right).applyInArrow(lambda a, b: _asked(a, b, k, same), _FOUND)
        order = Window.partitionBy("anchor", "bound").orderBy(F.desc("score"), F.asc_nulls_last("hit_id"), "hit")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = staged(ask(anchors, positives, True).select(F.col("anchor").alias("uid"), F.col("score").alias("bound"), F.col("hit_id").alias("positive_id")))
    # equal positive scores ask the same question
    windows = best.groupBy("uid").agg(F.collect_set("bound").alias("bounds"))
    hard = ask(anchors.join(windows, "uid"), negatives, False).select(F.col("anchor").alias("uid"), "bound", "rank", F.col("hit_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return named.join(hard, ["uid", "bound"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("bound").alias("positive_score"), "negative_score")
