"""Near-duplicates by HyperMinHash registers, banding and exact confirmation.

A text's set are its distinct 5-word shingles (A-Z lower-cased). One pass hashes them and keeps, per
set, 128 registers of 16 bits: the bucket's smallest hash as count of leading zeros and mantissa
bits; empty buckets borrow from others by a fixed random order. Texts with the same set are one
node. Bands of four registers are hashed; nodes that share a band are candidates. The Jaccard
estimate from equal registers, corrected for the collisions that registers of sets of these sizes
have by chance, discards candidates far below the threshold; the rest is confirmed on full sets.

Nodes that bands connect, directly or over others, form a candidate group; groups come from one edge
per node and band, and only groups are contracted, not their pairs. Every node travels once to its
group, in piles of small groups; a group of more than ``BLOCK_NODES`` is cut into blocks, and every
two blocks meet in a task of their own. A task looks at the pairs that share a band, each once, most
similar first, leaves out those already connected, and passes on only the links that connected
something. So no pair is ever a row, and components come out as if all candidates were confirmed.

Defined results: null or empty text, or text without words, has an empty set and links with
nothing; with fewer than five words the whole sequence is the one shingle; rows with equal ids
count as one document; a row without an id links like any other, takes its group's id and is not kept when it has one.
Nodes are identified by 64-bit digests of their sets. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import combine, lower_table, mix, run_hashes, text_blocks, words
from .common import staged
from .components import components

SHINGLE = 5
THRESHOLD = 75  # per cent
REGISTERS, BAND = 128, 4
_BUCKET_BITS, _MANTISSA = 7, 10
# Standard errors that an estimate may lie below the threshold.
SLACK = 5.0
# A task's groups hold about so many bytes of sets; a group of more nodes than a block is cut.
PILE_BYTES = 8 << 20
BLOCK_NODES = 1024
# Up to so many ids of candidate documents (16 bytes each) go to the texts; beyond, both are shuffled.
BROADCAST_IDS = 1_000_000
# Members that meet all members of their band at once; a pair takes about a kilobyte on the way.
_ROWS = 48


def shingle_sets(data: np.ndarray, offs: np.ndarray):
    """Yields the sorted distinct shingle hashes of text after text."""
    low = lower_table()[data]
    starts, ends, row_offs = words(low, offs)
    h = run_hashes(low, starts, ends, 1)
    n = len(h) - SHINGLE + 1
    whole = combine(*[h[j : n + j] for j in range(SHINGLE)]) if n > 0 else h[:0]
    for u, v in zip(row_offs[:-1], row_offs[1:], strict=True):
        if v - u >= SHINGLE:
            yield np.unique(whole[u : v - SHINGLE + 1])
        elif v > u:
            yield combine(*[h[j : j + 1] for j in range(u, v)], np.array([v - u], np.uint64))
        else:
            yield h[:0]


@cache
def _donors() -> np.ndarray:
    """For every bucket the order in which it asks others when it is empty."""
    r = np.random.default_rng(5)
    return np.stack([r.permutation(REGISTERS) for _ in range(REGISTERS)])


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers of a non-empty sorted set: leading zeros and mantissa of each bucket's smallest hash."""
    at = np.searchsorted(hashes, np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS))
    at = np.minimum(at, len(hashes) - 1)
    least = hashes[at]
    full = (least >> np.uint64(64 - _BUCKET_BITS)) == np.arange(REGISTERS, dtype=np.uint64)
    rest = least << np.uint64(_BUCKET_BITS)
    zeros = np.full(REGISTERS, 64 - _BUCKET_BITS, np.uint64)
    some = rest > 0
    # the exponent of the exact top 53 bits gives the leading zeros
    zeros[some] = (63 - (np.frexp((rest[some] >> np.uint64(11)).astype(np.float64))[1] + 10)).clip(0, 57)
    mantissa = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - _MANTISSA)
    out = (zeros << np.uint64(_MANTISSA) | mantissa).astype(np.uint16)
    if not full.all():
        order = _donors()
        donor = order[np.arange(REGISTERS), full[order].argmax(1)]
        out = np.where(full, out, out[donor])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, n_shingles, node (null for an empty set) and sketch of every row."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(1)):
                n, node, sketch = [], [], []
                for s in shingle_sets(data, offs):
                    n.append(len(s))
                    node.append(_node(s) if len(s) else None)
                    sketch.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "digest", "n_shingles", "node", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, digest bigint, n_shingles bigint, node bigint, sketch binary")


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """Hash of every band of every sketch; equal registers in different bands give different hashes."""
    keys = np.ascontiguousarray(sketches).view(np.uint64)
    return mix(keys + mix(np.arange(1, keys.shape[1] + 1, dtype=np.uint64)))


def bands(nodes: DataFrame) -> DataFrame:
    """(node, band) rows. Sets of one or two shingles have none: only an equal set is similar enough."""

    def run(batches):
        for b in batches:
            r = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(r)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel().view(np.int64))], ["node", "band"])

    return nodes.where("n_shingles > 2").select("node", "sketch").mapInArrow(run, "node bigint, band bigint")


def collisions(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that registers of two unrelated sets of these sizes are equal."""
    i = np.arange(0, 41)[:, None]

    def zeros(n):
        below = 1 - (1 - 2.0**-i) ** np.maximum(n / REGISTERS, 1.0)
        return below - np.concatenate([below[1:], np.zeros((1, below.shape[1]))])

    return (zeros(n_a) * zeros(n_b)).sum(0) / (1 << _MANTISSA)


def promising(same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Whether pairs with so many equal registers may reach the threshold."""
    t = threshold / 100
    chance = collisions(n_a, n_b)
    estimate = (same / REGISTERS - chance) / (1 - chance)
    slack = SLACK * np.sqrt(t * (1 - t) / np.minimum(REGISTERS, np.minimum(n_a, n_b)))
    return (estimate >= t - slack) & (100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def _candidates(keys: np.ndarray, block: np.ndarray):
    """Pairs of rows with a band in common, each once; of two blocks only pairs across them."""
    cross = len(np.unique(block)) > 1
    rows, width = keys.shape
    flat = keys.ravel()
    order = np.argsort(flat, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1], [True]]))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if hi - lo < 2:
            continue
        members, band = np.divmod(order[lo:hi], width)
        for k in range(0, len(members), _ROWS):
            a, b = np.meshgrid(members[k : k + _ROWS], members, indexing="ij")
            fit = (a < b) & (block[a] != block[b]) if cross else a < b
            a, b = a[fit], b[fit]
            first = (keys[a] == keys[b]).argmax(1) == band[0]
            yield a[first], b[first]


def links(nodes: np.ndarray, block: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links among some nodes that connect all that their candidate pairs connect."""
    n = np.array([len(x) for x in sets])
    label = np.arange(len(nodes))
    found = []
    keys = band_keys(sketches)
    for a, b in _candidates(keys, block):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        same = np.zeros(len(a), np.int64)
        for k in range(0, len(a), 1 << 15):
            part = slice(k, k + (1 << 15))
            same[part] = (sketches[a[part]] == sketches[b[part]]).sum(1)
        good = promising(same, n[a], n[b], threshold) if len(a) else np.zeros(0, bool)
        order = np.argsort(-same[good], kind="stable")
        for x, y in zip(a[good][order].tolist(), b[good][order].tolist(), strict=True):
            if label[x] == label[y]:
                continue
            common = _common(sets[x], sets[y])
            if 100 * common >= threshold * (n[x] + n[y] - common):
                found.append((int(nodes[x]), int(nodes[y])))
                label[label == label[y]] = label[x]
    return found


def group_links(grouped: DataFrame, threshold: int) -> DataFrame:
    """(a, b) links from rows (pile, low, high, block, node, sketch, hashes) that meet by the first three."""

    def run(table: pa.Table) -> pa.Table:
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        got = links(table.column("node").to_numpy(), table.column("block").to_numpy(), sketches, sets, threshold)
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    return grouped.groupBy("pile", "low", "high").applyInArrow(run, "a bigint, b bigint")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted (node, doc_id), from one text of each; nodes without an id are looked for among the rows without one."""

    def sets(texts: DataFrame) -> DataFrame:
        """(node, hashes) of (wanted, text); with a null ``wanted`` of any set, else of that one."""

        def run(batches):
            for b in batches:
                for lo, hi, data, offs in text_blocks(b.column(1)):
                    got = [(_node(s), w, s) for w, s in zip(b.column(0)[lo:hi].to_pylist(), shingle_sets(data, offs), strict=True) if len(s)]
                    got = [(n, s) for n, w, s in got if w in (n, None)]
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([s.tobytes() for _, s in got], pa.binary())], ["node", "hashes"])

        return texts.mapInArrow(run, "node bigint, hashes binary")

    named = wanted.where("doc_id is not null").select("doc_id", F.col("node").alias("wanted"))
    if named.count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    found = sets(docs.select("doc_id", "text").join(named, "doc_id").select("wanted", "text"))
    nameless = wanted.where("doc_id is null").select("node")
    n = nameless.count()
    if n:
        nameless = F.broadcast(nameless) if n <= BROADCAST_IDS else nameless
        found = found.unionByName(sets(docs.where("doc_id is null").select(F.lit(None).cast("bigint").alias("wanted"), "text")).join(nameless, "node", "left_semi"))
    return found.dropDuplicates(["node"])


def _grouped(docs: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """node, doc_id (the smallest of its rows) and root of every set of the rows that ``signatures`` gave."""
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = staged(nodes)
    every = bands(nodes)
    hubs = every.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("band", "hub")
    groups = components(every.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    wanted = staged(groups.join(nodes.select("node", "doc_id", "sketch", "n_shingles"), "node"))
    sets = full_sets(docs, wanted)
    # small groups share piles; a large one is a pile of its own, cut into blocks that meet two by two
    sizes = wanted.groupBy("root").agg(F.count("node").alias("size"), F.sum("n_shingles").alias("weight"))
    piles = max(1, -(-(sizes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0] * 8) // PILE_BYTES))
    blocks = F.ceil(F.col("size") / BLOCK_NODES)
    dealt = wanted.select("node", "root", "sketch").join(sizes, "root").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    pile = F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod("root", F.lit(piles)))
    dealt = dealt.select("node", "sketch", "block", pile.alias("pile"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    single = F.col("low") == F.col("high")
    found = group_links(dealt.join(sets, "node").withColumn("block", F.when(single, F.lit(0)).otherwise(F.col("block"))), threshold)
    roots = components(found)
    return nodes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = staged(signatures(docs))
    own = _grouped(docs, rows, threshold)
    ids = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = own.join(ids, "root").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of every group, all columns as they are.

    A group keeps the row with its smallest id (a null id is the largest), of several texts under that id
    the one with the smallest digest, of several such rows one. Rows are told apart by id and digest of the
    text, so another text under the id of one that goes stays. Rows with an empty set stay.
    """
    rows = staged(signatures(docs))
    texts = rows.where("node is not null").groupBy("node", "doc_id", "digest").count()
    texts = staged(texts.join(_grouped(docs, rows, threshold).select("node", "root"), "node"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "node", "digest")
    best = texts.groupBy("root").agg(F.min(place).alias("best"))
    judged = staged(texts.join(best, "root").select("doc_id", "digest", "count", (place == F.col("best")).alias("stays")))

    def those(condition: str) -> DataFrame:
        return judged.where(condition).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()

    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_digest"))
    kept = docs.join(those("not stays"), same, "left_anti")
    repeated = those("stays and count > 1")
    if repeated.isEmpty():
        return kept
    once = docs.join(repeated, same).dropDuplicates(["_id", "_digest"]).drop("_id", "_digest")
    return kept.join(repeated, same, "left_anti").unionByName(once)
