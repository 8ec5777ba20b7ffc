"""Language-model scoring: a probabilistic suffix tree, beside an add-one unigram of words.

Text is lower-cased (A-Z) and read as tokens: words, then one end. For the tree the tokens are
spelled as bytes, words joined by one space and closed by an end symbol, so the product over
symbols is a probability of the token sequence. The tree's contexts are the last 0 to ``DEPTH``
symbols. A context is kept if it was seen ``MIN_COUNT`` times and its next-symbol distribution
diverges from that of its suffix (a likelihood-ratio test and a least divergence); suffixes of kept
contexts are kept too. None of these bounds grows with the corpus, so the tree does. Distributions
are smoothed by interpolation with the suffix's, down to add-one over bytes. A symbol is scored in
the state of the longest kept suffix before it.

Counts cover all training texts: tasks count n-grams and words with arrays, Spark sums them. Contexts
that end in the same ``SHARED`` + 1 symbols are selected and smoothed in one task, from the
distributions of the ``SHARED`` last symbols, and stay a table. The most frequent contexts, about
``HEAD_CONTEXTS`` at most, are broadcast with a bit table of fixed size that tells which others may be
kept; a symbol in one of those is looked up by a join. The unigram needs the count of every word: the
``HEAD`` most frequent are broadcast (a bounded table), rarer ones are looked up by a join of the
rest, whose keys are rare by construction.

Words are identified by 64-bit hashes. Defined results: null or empty text is the end token alone;
equal rows are scored one by one; without training text every symbol has probability 1/256.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import lower_table, mix, ranges, run_hashes, text_blocks, words
from .common import staged

# With the symbol itself a gram fills the 64 bits of its key.
DEPTH = 7
MIN_COUNT = 2
MIN_DIVERGENCE = 0.002
MIN_RATIO = 30.0
HEAD = 200_000
HEAD_CONTEXTS = 200_000
# Contexts of so many symbols are shared by all tasks that select deeper ones; a task's share of grams.
SHARED = 2
GROUP_GRAMS = 250_000
# Bits that say which contexts outside the head may be kept; a bit too many costs a lookup only.
FILTER_BITS = 26
# Scored texts are cut into blocks of so many bytes; one holds a few arrays of eight bytes a symbol.
SCORE_BYTES = 1 << 19
# Distinct keys that a task holds before it passes its counts on.
HELD = 2_500_000
_SPACE, _END = 32, 10  # inside words neither occurs
END_TOKEN = -1  # the end's key among the hashed words
_WORD, _GRAM = 0, 1


@dataclass
class Tree:
    """Kept contexts per depth (sorted keys to state), seen symbols per state, weights of suffixes."""

    contexts: list[np.ndarray]
    states: list[np.ndarray]
    pairs: np.ndarray  # state * 256 + symbol, sorted
    values: np.ndarray  # probability of the pair
    back: np.ndarray  # weight of the suffix's distribution per state
    parent: np.ndarray
    near: list[tuple[np.ndarray, np.ndarray]]  # contexts per depth, the last symbol first, with their states
    thin: np.ndarray | None = None  # bits of the kept contexts that only the table has
    table: DataFrame | None = None  # kept contexts deeper than SHARED: level, context, total, back, symbols, probs, slot


@dataclass
class Level:
    """All contexts of one depth: sorted (context, symbol) pairs, and per context its count and kept flag."""

    pairs: np.ndarray
    n: np.ndarray
    p: np.ndarray  # smoothed
    contexts: np.ndarray
    first: np.ndarray
    total: np.ndarray
    back: np.ndarray
    kept: np.ndarray


def spell(data: np.ndarray, offs: np.ndarray):
    """Symbols of all texts, offsets of the texts in them, word hashes and offsets of the texts in those."""
    low = lower_table()[data]
    starts, ends, row_offs = words(low, offs)
    hashes = run_hashes(low, starts, ends, 13)
    lens = ends - starts
    n_words = np.diff(row_offs)
    size = np.concatenate([[0], np.cumsum(lens + 1)])
    # a text of words takes their bytes and one symbol behind each; a text without words the end alone
    text_len = np.where(n_words > 0, size[row_offs[1:]] - size[row_offs[:-1]], 1)
    text_offs = np.concatenate([[0], np.cumsum(text_len)])
    shift = np.repeat(np.cumsum(n_words == 0) - (n_words == 0), n_words)  # empty texts before each word
    at = size[:-1] + shift
    out = np.full(int(text_offs[-1]), _SPACE, np.uint8)
    out[ranges(at, lens)] = low[ranges(starts, lens)]
    out[text_offs[1:] - 1] = _END
    return out, text_offs, hashes, row_offs


def grams(symbols: np.ndarray, text_offs: np.ndarray) -> np.ndarray:
    """The DEPTH symbols before and the symbol itself, packed, for every position; end marks stand before a text."""
    padded_at = text_offs[:-1] + DEPTH * np.arange(len(text_offs) - 1)
    lens = np.diff(text_offs)
    padded = np.full(len(symbols) + DEPTH * len(lens), _END, np.uint64)
    where = ranges(padded_at + DEPTH, lens)
    padded[where] = symbols
    key = np.zeros(len(padded), np.uint64)
    for j in range(DEPTH + 1):
        back = DEPTH - j
        key[back:] |= padded[: len(padded) - back] << np.uint64(8 * back)
    return key[where]


def _counted(batches):
    """Rows (kind, key, n) of one task: words and packed grams with their counts."""
    held: dict[int, list] = {_WORD: [], _GRAM: []}
    size = 0

    def merged(kind):
        keys = np.concatenate([k for k, _ in held[kind]])
        counts = np.concatenate([c for _, c in held[kind]])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def flush():
        for kind in held:
            if held[kind]:
                keys, counts = merged(kind)
                for i in range(0, len(keys), 100_000):
                    k, c = keys[i : i + 100_000], counts[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["kind", "key", "n"])
                held[kind] = []

    for b in batches:
        for lo, hi, data, offs in text_blocks(b.column(0)):
            symbols, text_offs, hashes, _ = spell(data, offs)
            for kind, keys in ((_WORD, hashes), (_GRAM, grams(symbols, text_offs))):
                k, c = np.unique(keys, return_counts=True)
                held[kind].append((k, c.astype(np.int32)))
                size += len(k)
            held[_WORD].append((np.array([END_TOKEN], np.int64).view(np.uint64), np.array([hi - lo], np.int32)))
            if size > HELD:
                for kind in held:
                    held[kind] = [merged(kind)]
                size = sum(len(held[kind][0][0]) for kind in held)
                if size > HELD // 2:
                    yield from flush()
                    size = 0
    yield from flush()


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all texts: counts of words (hashed) and of grams (packed)."""
    return docs.select("text").mapInArrow(_counted, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _mask(symbols: int) -> np.uint64:
    return np.uint64((1 << (8 * symbols)) - 1)


def _level(keys: np.ndarray, counts: np.ndarray, k: int, above: Level | np.ndarray) -> Level:
    """Contexts of depth k from grams; ``above`` has their suffixes (for k = 1 the root's distribution)."""
    pairs, inv = np.unique(keys & _mask(k + 1), return_inverse=True)
    n = np.bincount(inv, counts, len(pairs))
    contexts, first, size = np.unique(pairs >> np.uint64(8), return_index=True, return_counts=True)
    if not len(pairs):
        z = np.zeros(0)
        return Level(pairs, n, z, contexts, first, z, z, z.astype(bool))
    total = np.add.reduceat(n, first)
    own = np.repeat(np.arange(len(contexts)), size)
    if k == 1:
        q = below = above[(pairs & np.uint64(255)).astype(np.int64)]
    else:
        at = np.searchsorted(above.pairs, pairs & _mask(k))
        owner = np.searchsorted(above.contexts, (pairs & _mask(k)) >> np.uint64(8))
        q, below = above.n[at] / above.total[owner], above.p[at]
    share = n / total[own]
    gain = np.add.reduceat(share * np.log(share / q), first)
    back = size / (total + size)
    p = back[own] * below + n / (total + size)[own]
    return Level(pairs, n, p, contexts, first, total, back, (total >= MIN_COUNT) & (gain >= MIN_DIVERGENCE) & (2 * total * gain >= MIN_RATIO))


def _close(above: Level, k: int, contexts: np.ndarray) -> None:
    """Keeps the suffixes, one level up, of kept contexts of depth k."""
    above.kept[np.searchsorted(above.contexts, contexts & _mask(k - 1))] = True


def slots(level: int, contexts: np.ndarray) -> np.ndarray:
    """The bit of every context in the table of bits."""
    with np.errstate(over="ignore"):
        return (mix(contexts + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


_TABLE = "level tinyint, context bigint, total bigint, back double, symbols array<smallint>, probs array<double>, slot bigint"


def selected(keys: np.ndarray, counts: np.ndarray, above: Level):
    """Kept contexts deeper than SHARED, as record batches, of grams whose suffixes of SHARED + 1 symbols are complete."""
    levels = []
    for k in range(SHARED + 1, DEPTH + 1):
        above = _level(keys, counts, k, above)
        levels.append(above)
    for k in range(DEPTH, SHARED + 1, -1):
        _close(levels[k - SHARED - 2], k, levels[k - SHARED - 1].contexts[levels[k - SHARED - 1].kept])
    for k, level in enumerate(levels, SHARED + 1):
        kept = np.flatnonzero(level.kept)
        if not len(kept):
            continue
        size = np.diff(np.append(level.first, len(level.pairs)))[kept]
        at = ranges(level.first[kept], size)
        offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        symbols = (level.pairs[at] & np.uint64(255)).astype(np.int16)
        contexts = level.contexts[kept]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(kept), k, np.int8)), pa.array(contexts.view(np.int64)), pa.array(level.total[kept].astype(np.int64)), pa.array(level.back[kept]),
                pa.ListArray.from_arrays(offs, pa.array(symbols)), pa.ListArray.from_arrays(offs, pa.array(level.p[at])), pa.array(slots(k, contexts)),
            ],
            ["level", "context", "total", "back", "symbols", "probs", "slot"],
        )


def _frequency():
    """A context's class of counts; sixteen classes to a doubling."""
    return F.floor(F.log2("total") * 16)


def grow(grams_table: DataFrame) -> Tree:
    """The tree of (key, n) rows: contexts selected and smoothed by tasks, the frequent ones gathered."""
    short = grams_table.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * (SHARED + 1))) - 1)).alias("key")).agg(F.sum("n").alias("n"), F.count("n").alias("grams")).toArrow()
    keys, counts = (short.column(i).to_numpy().astype(np.uint64) for i in (0, 1))
    dense = np.bincount((keys & np.uint64(255)).astype(np.int64), counts, 256)
    root = (dense + 1) / (dense.sum() + 256)
    shared: list = [root]
    for k in range(1, SHARED + 1):
        shared.append(_level(keys, counts, k, shared[-1]))
    above = grams_table.sparkSession.sparkContext.broadcast(shared[-1])
    groups = max(1, -(-int(short.column(2).to_numpy().sum()) // GROUP_GRAMS))
    suffix = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * (SHARED + 1))) - 1))

    def run(table: pa.Table) -> pa.Table:
        got = list(selected(table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy(), above.value))
        return pa.Table.from_batches(got) if got else _empty()

    dealt = grams_table.select("key", "n", F.pmod(F.xxhash64(suffix), F.lit(groups)).alias("part"))
    table = staged(dealt.groupBy("part").applyInArrow(run, _TABLE))
    # what is kept below the shared levels keeps its suffixes there; at most 2^16 rows
    kept = table.where(F.col("level") == SHARED + 1).select(F.col("context").bitwiseAND(F.lit(int(_mask(SHARED)))).alias("c")).distinct().toArrow().column(0).to_numpy().astype(np.uint64)
    _close(shared[SHARED], SHARED + 1, kept)
    for k in range(SHARED, 1, -1):
        _close(shared[k - 1], k, shared[k].contexts[shared[k].kept])
    least, have = 1 << 30, 0
    for r in table.groupBy(_frequency().alias("c")).count().orderBy(F.desc("c")).collect():
        have += r["count"]
        if have > HEAD_CONTEXTS:
            break
        least = r.c
    head = table.where(_frequency() >= least).select("level", "context", "back", "symbols", "probs").toArrow()
    rest = table.where(_frequency() < least)
    words = rest.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    thin = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    thin[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return replace(_gathered(shared, head), thin=thin if words.num_rows else None, table=rest)


def _empty() -> pa.Table:
    return pa.table({"level": pa.array([], pa.int8()), "context": pa.array([], pa.int64()), "total": pa.array([], pa.int64()), "back": pa.array([], pa.float64()), "symbols": pa.array([], pa.list_(pa.int16())), "probs": pa.array([], pa.list_(pa.float64())), "slot": pa.array([], pa.int64())})


def _gathered(shared: list, head: pa.Table) -> Tree:
    """States of the shared levels and of the gathered contexts, level by level."""
    contexts, states, pairs, values = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], [np.arange(256)], [shared[0]]
    back, parent = [np.zeros(1)], [np.zeros(1, np.int64)]
    head = head.combine_chunks()
    level = head.column("level").to_numpy()
    for k in range(1, DEPTH + 1):
        if k <= SHARED:
            own = shared[k]
            kept = np.flatnonzero(own.kept)
            size = np.diff(np.append(own.first, len(own.pairs)))[kept] if len(kept) else np.zeros(0, np.int64)
            at = ranges(own.first[kept], size)
            c, w, symbols, p = own.contexts[kept], own.back[kept], (own.pairs[at] & np.uint64(255)).astype(np.int64), own.p[at]
        else:
            part = head.take(pa.array(np.flatnonzero(level == k))).combine_chunks()
            c = part.column("context").to_numpy().view(np.uint64)
            by = np.argsort(c)
            part, c = part.take(pa.array(by)).combine_chunks(), c[by]
            w, own = part.column("back").to_numpy(), [part.column(x).combine_chunks() for x in ("symbols", "probs")]
            size = own[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            symbols, p = own[0].flatten().to_numpy(zero_copy_only=False).astype(np.int64), own[1].flatten().to_numpy(zero_copy_only=False)
        number = sum(map(len, states)) + np.arange(len(c))
        up = np.searchsorted(contexts[-1], c & _mask(k - 1))
        parent.append(states[-1][up])
        contexts.append(c), states.append(number), back.append(w), values.append(p)
        pairs.append(np.repeat(number, size) * 256 + symbols)
    near = []
    for c, s in zip(contexts, states, strict=True):
        turned = c.byteswap()
        order = np.argsort(turned)
        near.append((turned[order], s[order]))
    return Tree(contexts, states, np.concatenate(pairs), np.concatenate(values), np.concatenate(back), np.concatenate(parent), near)


def located(tree: Tree, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest gathered state of every packed gram, and its depth."""
    state, depth = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    turned = (keys >> np.uint64(8)).byteswap()
    left = np.arange(len(keys))
    for k in range(1, len(tree.near)):
        known, states = tree.near[k]
        if not len(known) or not len(left):
            break
        context = turned[left] & ~_mask(8 - k)
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        hit = known[at] == context
        left = left[hit]
        state[left], depth[left] = states[at[hit]], k
    return state, depth


def outside(tree: Tree, keys: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Whether a deeper context than the gathered one may be in the table."""
    out = np.zeros(len(keys), bool)
    if tree.thin is not None:
        for k in range(SHARED + 1, DEPTH + 1):
            own = np.flatnonzero(depth == k - 1)
            bit = slots(k, (keys[own] >> np.uint64(8)) & _mask(k))
            out[own] = (tree.thin[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def log10_of(tree: Tree, keys: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of the symbol of every packed gram in its longest gathered state."""
    state = (located(tree, keys)[0] if state is None else state).copy()
    symbol = (keys & np.uint64(255)).astype(np.int64)
    out, weight = np.zeros(len(keys)), np.ones(len(keys))
    left = np.arange(len(keys))
    while len(left):
        want = state[left] * 256 + symbol[left]
        at = np.minimum(np.searchsorted(tree.pairs, want), len(tree.pairs) - 1)
        hit = tree.pairs[at] == want
        out[left[hit]] = weight[left[hit]] * tree.values[at[hit]]
        left = left[~hit]
        weight[left] *= tree.back[state[left]]
        state[left] = tree.parent[state[left]]
    return np.log10(out)


def looked_up(grams_: DataFrame, tree: Tree, shared) -> DataFrame:
    """(key, value): log10 probability of distinct packed grams whose contexts go on in the table."""

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            state, depth = located(shared.value.tree, keys)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(depth.astype(np.int8)), pa.array(log10_of(shared.value.tree, keys, state))], ["key", "depth", "base"])

    found = grams_.mapInArrow(run, "key bigint, depth tinyint, base double").withColumn("level", F.explode(F.expr(f"sequence(cast(depth + 1 as tinyint), {DEPTH}Y)")))
    context = F.expr("shiftrightunsigned(key, 8) & case level " + " ".join(f"when {k} then {int(_mask(k))}L" for k in range(1, DEPTH + 1)) + " end")
    table = tree.table.select("level", "context", "back", "symbols", "probs")
    met = found.withColumn("context", context).join(table, ["level", "context"], "left")
    # symbols and probabilities have the same places; a symbol that was not seen has no probability
    place = F.expr("array_position(symbols, cast(key & 255 as smallint))")
    met = met.withColumn("p", F.when(place > 0, F.expr("try_element_at(probs, cast(array_position(symbols, cast(key & 255 as smallint)) as int))")))
    return met.groupBy("key").agg(
        (F.coalesce(F.max_by(F.log10("p"), F.when(F.col("p").isNotNull(), F.col("level"))), F.first("base")) + F.coalesce(F.sum(F.when(F.col("p").isNull(), F.log10("back"))), F.lit(0.0))).alias("value")
    )


@dataclass
class Model:
    tree: Tree
    head_keys: np.ndarray
    head_counts: np.ndarray
    tokens: int
    distinct: int


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words (hash key, n) that the rare ones are looked up in."""
    table = staged(counts(docs))
    own = table.where(F.col("kind") == _WORD)
    n, v = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    # the least count that leaves at most HEAD words, from how many words have each count
    frequency = own.where(F.col("n") > 1).groupBy(F.least("n", F.lit(100_000)).alias("c")).agg(F.count("n").alias("words")).orderBy(F.desc("c")).collect()
    least, have = 1 << 62, 0
    for r in frequency:
        have += r.words
        if have > HEAD:
            break
        least = r.c
    head = own.where(F.col("n") >= least).select("key", "n").toArrow()
    keys = head.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    tree = grow(table.where(F.col("kind") == _GRAM).select("key", "n"))
    return Model(tree, keys[order], head.column(1).to_numpy()[order], n, v), own.select("key", "n")


def score(docs: DataFrame, model: Model, word_counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, tree=replace(model.tree, table=None)))
    norm = math.log10(model.tokens + model.distinct + 1)

    def run(batches):
        m = shared.value
        row = TaskContext.get().partitionId() << 40
        logs = np.log10(m.head_counts + 1.0) - norm
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(1), SCORE_BYTES):
                symbols, text_offs, hashes, row_offs = spell(data, offs)
                keys, inv = np.unique(grams(symbols, text_offs).byteswap(), return_inverse=True)
                keys = keys.byteswap()
                state, depth = located(m.tree, keys)
                logs10, far = log10_of(m.tree, keys, state), outside(m.tree, keys, depth)
                logs10[far] = 0
                tree = np.add.reduceat(logs10[inv], text_offs[:-1])
                deep = np.flatnonzero(far[inv])
                deep_offs = np.searchsorted(deep, text_offs).astype(np.int32)
                # every text's tokens: its words, then the end
                n = np.diff(row_offs)
                tokens = np.full(len(hashes) + len(n), END_TOKEN, np.int64).view(np.uint64)
                at = row_offs[:-1] + np.arange(len(n))
                tokens[ranges(at, n)] = hashes
                pos = np.minimum(np.searchsorted(m.head_keys, tokens), max(len(m.head_keys) - 1, 0))
                hit = m.head_keys[pos] == tokens if len(m.head_keys) else np.zeros(len(tokens), bool)
                base = np.zeros(len(tokens))
                base[hit] = logs[pos[hit]]
                known = np.add.reduceat(hit.astype(np.int64), at)
                rare = np.flatnonzero(~hit)
                rare_offs = np.searchsorted(rare, np.append(at, len(tokens))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(n))), b.column(0)[lo:hi], pa.array(n + 1), pa.array(known), pa.array(np.add.reduceat(base, at)), pa.array(tree), pa.ListArray.from_arrays(rare_offs, pa.array(tokens[rare].view(np.int64))), pa.ListArray.from_arrays(deep_offs, pa.array(keys[inv[deep]].view(np.int64)))],
                    ["row", "doc_id", "n_tokens", "head_known", "head_score", "score", "rare", "deep"],
                )
                row += len(n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    first = staged(docs.select("doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, head_known bigint, head_score double, score double, rare array<bigint>, deep array<bigint>"))
    rare = first.select("row", F.explode("rare").alias("key"))
    base = rare.join(word_counts, "key", "left").groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0) - norm).alias("base"))
    out = first.join(base, "row", "left")
    value = F.lit(0.0)
    if model.tree.thin is not None:
        deep = first.select("row", F.explode("deep").alias("key"))
        values = looked_up(deep.select("key").distinct(), model.tree, shared)
        out = out.join(deep.join(values, "key").groupBy("row").agg(F.sum("value").alias("value")), "row", "left")
        value = F.coalesce("value", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("score") + value).alias("score"),
    )
