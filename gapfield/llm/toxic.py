"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are its own hashed embedding and the maximum over hashed embeddings of its
character n-grams (three to five bytes with begin and end marks). A forward and a backward gated
unit read windows of ``WINDOW`` words that overlap by half; attention pools the states of a window
into one vector and a linear layer gives its logit. A text is scored by all its windows and takes
the highest; a logistic curve fitted on labelled texts kept aside turns logits into probabilities.

Training draws ``PER_CLASS`` labelled rows per class by a hash of the id (a documented bound) and
uses their whole texts: every step runs all windows of a few texts forward and learns through the
highest window of each. The first embedding dimension starts from log-odds of the training texts.

Defined results: null or empty text is one window without words and gets the probability of the
bias; without labelled rows of both classes the score is the share of class 1 (0.5 without any);
equal rows are scored one by one; labels that are null or neither 0 nor 1 are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import combine, lower_table, mix, ranges, run_hashes, text_blocks, words
from .common import drawn
from .nbsvm import calibrate

WINDOW, STRIDE = 64, 32
WORD_BITS, GRAM_BITS = 15, 16
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 10, 12, 8
PER_CLASS = 1500
EPOCHS = 5
TEXTS_PER_STEP = 32
# Windows that run side by side while scoring.
LANES = 1024


@dataclass
class Model:
    params: dict[str, np.ndarray]
    slope: float
    shift: float


def _inputs(data: np.ndarray, offs: np.ndarray):
    """Word numbers per position, row offsets, and per distinct word its hash and its n-gram hashes."""
    low = lower_table()[data]
    starts, ends, row_offs = words(low, offs)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, row_offs, z, z, z
    hashes, first, inv = np.unique(run_hashes(low, starts, ends, 9), return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    lens = ends - starts
    at = np.concatenate([[0], np.cumsum(lens + 2)])
    text = np.full(int(at[-1]), 256, np.uint64)  # begin mark
    text[ranges(at[:-1] + 1, lens)] = low[ranges(starts, lens)]
    text[at[1:] - 1] = 257
    text = mix(text + np.uint64(3))
    grams, owner = [], []
    for k in (3, 4, 5):
        n = np.maximum(lens + 2 - (k - 1), 1 if k == 3 else 0)  # a word of one letter has its 3-gram
        here = ranges(at[:-1], n)
        grams.append(combine(*[text[np.minimum(here + j, len(text) - 1)] for j in range(k)]) >> np.uint64(64 - GRAM_BITS))
        owner.append(np.repeat(np.arange(len(lens)), n))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    grams = np.concatenate(grams)[order].astype(np.int64)
    counts = np.bincount(owner, minlength=len(lens))
    return inv, row_offs, (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), grams, np.cumsum(counts) - counts


def windows(row_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of all overlapping windows; a row has one at least."""
    n = np.diff(row_offs)
    per_row = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), per_row)
    k = ranges(np.zeros(len(n), np.int64), per_row)
    start = np.minimum(k * STRIDE, np.maximum(n[row] - WINDOW, 0))
    return row_offs[row] + start, np.minimum(n[row], WINDOW), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def encode_words(p: dict, word: np.ndarray, grams: np.ndarray, gram_at: np.ndarray) -> np.ndarray:
    chars = np.maximum.reduceat(p["gram"][grams], gram_at, axis=0) if len(grams) else np.zeros((0, GRAM_DIM), np.float32)
    return np.concatenate([p["word"][word], chars], 1)


def _lanes(per_word: np.ndarray, inv: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(WINDOW, lanes, features) of windows; positions beyond the text are zero."""
    at = start + np.arange(WINDOW)[:, None]
    inside = np.arange(WINDOW)[:, None] < length
    if not len(per_word):
        return np.zeros((*inside.shape, per_word.shape[1]), np.float32)
    out = per_word[inv[np.minimum(at, len(inv) - 1)]]
    out[~inside] = 0
    return out


def _unit(xp: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """States of one gated unit over (steps, lanes, 3 * HIDDEN); with ``keep`` also what learning needs."""
    steps, lanes, _ = xp.shape
    h = np.zeros((lanes, HIDDEN), np.float32)
    out = np.empty((steps, lanes, HIDDEN), np.float32)
    kept = []
    for t in range(steps):
        hu = h @ u
        gates = _sigmoid(xp[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        inner = hu[:, 2 * HIDDEN :] + b
        new = np.tanh(xp[t, :, 2 * HIDDEN :] + r * inner)
        if keep:
            kept.append((h, r, z, inner, new))
        h = new + z * (h - new)
        out[t] = h
    return out, kept


def _unit_back(d_out: np.ndarray, kept: list, u: np.ndarray):
    """Gradients of one unit: of its inputs, its recurrent matrix and its inner bias."""
    steps, lanes, _ = d_out.shape
    d_xp = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
    d_u, d_b = np.zeros_like(u), np.zeros(HIDDEN, np.float32)
    d_h = np.zeros((lanes, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, r, z, inner, new = kept[t]
        d_h = d_h + d_out[t]
        d_new = d_h * (1 - z) * (1 - new * new)
        d_z = d_h * (h - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_inner = d_new * r
        d_xp[t] = np.concatenate([d_r, d_z, d_new], 1)
        d_hu = np.concatenate([d_r, d_z, d_inner], 1)
        d_u += h.T @ d_hu
        d_b += d_inner.sum(0)
        d_h = d_h * z + d_hu @ u.T
    return d_xp, d_u, d_b


def forward(p: dict, per_word: np.ndarray, inv, start, length, keep: bool = False):
    """Logits of windows; with ``keep`` also what learning needs."""
    fx = _lanes(per_word @ p["wf"] + p["bf"], inv, start, length)
    bx = _lanes(per_word @ p["wb"] + p["bb"], inv, start, length)[::-1]
    hf, kf = _unit(fx, p["uf"], p["cf"], keep)
    hb, kb = _unit(bx, p["ub"], p["cb"], keep)
    h = np.concatenate([hf, hb[::-1]], 2)
    tall = np.tanh(h @ p["wa"] + p["ba"])
    weight = tall @ p["va"]
    inside = np.arange(WINDOW)[:, None] < length
    weight = np.where(inside, weight, -np.inf)
    top = weight.max(0)
    weight = np.exp(weight - np.where(np.isfinite(top), top, 0))
    weight /= np.maximum(weight.sum(0), 1e-20)
    pooled = (weight[:, :, None] * h).sum(0)
    logit = pooled @ p["wo"] + p["bo"][0]
    return logit, (kf, kb, h, tall, weight, pooled, inside) if keep else None


def backward(p: dict, d_logit: np.ndarray, kept) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of the dense parameters, and of the projected inputs of both directions."""
    kf, kb, h, tall, weight, pooled, inside = kept
    g = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["wo"]
    d_h = weight[:, :, None] * d_pooled
    d_w = (h * d_pooled).sum(2)
    d_w = weight * (d_w - (weight * d_w).sum(0))
    g["va"] = np.einsum("tla,tl->a", tall, d_w)
    d_tall = d_w[:, :, None] * p["va"] * (1 - tall * tall)
    g["wa"] = np.einsum("tlh,tla->ha", h, d_tall)
    g["ba"] = d_tall.sum((0, 1))
    d_h = d_h + d_tall @ p["wa"].T
    d_fx, g["uf"], g["cf"] = _unit_back(d_h[:, :, :HIDDEN], kf, p["uf"])
    d_bx, g["ub"], g["cb"] = _unit_back(d_h[::-1, :, HIDDEN:], kb, p["ub"])
    d_bx = d_bx[::-1]
    d_fx[~inside], d_bx[~inside] = 0, 0
    return g, d_fx, d_bx


def fresh(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d = WORD_DIM + GRAM_DIM
    n = lambda *s, by: r.normal(0, by, s).astype(np.float32)
    return {
        "word": n(1 << WORD_BITS, WORD_DIM, by=0.05), "gram": n(1 << GRAM_BITS, GRAM_DIM, by=0.05),
        "wf": n(d, 3 * HIDDEN, by=0.3), "bf": np.zeros(3 * HIDDEN, np.float32), "uf": n(HIDDEN, 3 * HIDDEN, by=0.25), "cf": np.zeros(HIDDEN, np.float32),
        "wb": n(d, 3 * HIDDEN, by=0.3), "bb": np.zeros(3 * HIDDEN, np.float32), "ub": n(HIDDEN, 3 * HIDDEN, by=0.25), "cb": np.zeros(HIDDEN, np.float32),
        "wa": n(2 * HIDDEN, ATTENTION, by=0.3), "ba": np.zeros(ATTENTION, np.float32), "va": n(ATTENTION, by=0.5), "wo": n(2 * HIDDEN, by=0.3), "bo": np.zeros(1, np.float32),
    }


class _Adam:
    """Adam steps; rows of tables are stepped only where they have a gradient."""

    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, dense: dict, sparse: dict) -> None:
        self.t += 1
        for k, (rows, g) in (sparse | {k: (slice(None), g) for k, g in dense.items()}).items():
            m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            v = self.v[k][rows] = 0.99 * self.v[k][rows] + 0.01 * g * g
            self.p[k][rows] -= (self.rate * m / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)


def _log_odds(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    count = [np.zeros(size), np.zeros(size)]
    for r, c in zip(rows, y, strict=True):
        count[int(c)][r] += 1
    n = [max((y == c).sum(), 1) for c in (0, 1)]
    odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
    seen = count[0] + count[1]
    return np.clip(odds * seen / (seen + 4), -3, 3).astype(np.float32)


def learn(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> dict[str, np.ndarray]:
    p = fresh(seed)
    # kept for all epochs, so in the smallest type that holds them
    prepared = [tuple(x.astype(np.int32) for x in _inputs(np.frombuffer(t, np.uint8), np.array([0, len(t)]))) for t in texts]
    p["word"][:, 0] = _log_odds([np.unique(x[2]) for x in prepared], y, 1 << WORD_BITS)
    p["gram"][:, 0] = _log_odds([np.unique(x[3]) for x in prepared], y, 1 << GRAM_BITS)
    adam = _Adam(p, 0.01)
    balance = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    order = np.random.default_rng(seed + 1)
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs)
        shuffled = order.permutation(len(texts))
        for lo in range(0, len(texts), TEXTS_PER_STEP):
            part = shuffled[lo : lo + TEXTS_PER_STEP]
            word, grams, gram_at, inv, start, length, row = _gathered([prepared[i] for i in part])
            e = encode_words(p, word, grams, gram_at)
            logit = np.concatenate([forward(p, e, inv, start[i : i + LANES], length[i : i + LANES])[0] for i in range(0, len(start), LANES)])
            best = _best(logit, row, len(part))
            start, length = start[best], length[best]
            logit, kept = forward(p, e, inv, start, length, True)
            d_logit = ((1 / (1 + np.exp(-logit)) - y[part]) * balance[part] / len(part)).astype(np.float32)
            dense, d_fx, d_bx = backward(p, d_logit, kept)
            used = kept[-1]
            at = inv[np.minimum(start + np.arange(WINDOW)[:, None], max(len(inv) - 1, 0))[used]] if len(inv) else np.zeros(0, np.int64)
            d_e = np.zeros_like(e)
            for d, w, b, name in ((d_fx, "wf", "bf", "f"), (d_bx, "wb", "bb", "b")):
                flat = d[used]
                d_p = np.zeros((len(e), 3 * HIDDEN), np.float32)
                np.add.at(d_p, at, flat)
                dense[w], dense[b] = e.T @ d_p, flat.sum(0)
                d_e += d_p @ p[w].T
            touched = np.unique(at)
            sparse = {"word": _scatter(word[touched], d_e[touched, :WORD_DIM])}
            n = np.diff(np.append(gram_at, len(grams)))[touched]
            here, owner = ranges(gram_at[touched], n), np.repeat(touched, n)
            g = np.where(p["gram"][grams[here]] == e[owner, WORD_DIM:], d_e[owner, WORD_DIM:], 0)
            sparse["gram"] = _scatter(grams[here], g)
            adam.step(dense, sparse)
    return p


def _gathered(parts: list):
    """Several prepared texts as one: word and n-gram numbers, windows and the text of each."""
    word, grams, gram_at, inv, row_offs = [], [], [], [], [0]
    n_word = n_gram = 0
    for i, _, w, g, a in parts:
        inv.append(i + n_word), word.append(w), grams.append(g), gram_at.append(a + n_gram)
        n_word += len(w)
        n_gram += len(g)
        row_offs.append(row_offs[-1] + len(i))
    start, length, row = windows(np.array(row_offs))
    return *(np.concatenate(x).astype(np.int64) for x in (word, grams, gram_at, inv)), start, length, row


def _best(logit: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The window with the highest logit of every row; rows are in order and all have one."""
    order = np.lexsort((-logit, row))
    return order[np.searchsorted(row[order], np.arange(rows))]


def _scatter(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inv = np.unique(rows, return_inverse=True)
    out = np.zeros((len(keys), g.shape[1]), np.float32)
    np.add.at(out, inv, g)
    return keys, out


def logits(p: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Highest window logit of every text of a block."""
    inv, row_offs, word, grams, gram_at = _inputs(data, offs)
    e = encode_words(p, word, grams, gram_at)
    start, length, row = windows(row_offs)
    got = np.concatenate([forward(p, e, inv, start[i : i + LANES], length[i : i + LANES])[0] for i in range(0, len(start), LANES)])
    return np.maximum.reduceat(got, np.searchsorted(row, np.arange(len(offs) - 1)))


def fit(texts: list[bytes], y: np.ndarray, weights: np.ndarray) -> Model:
    """Model from texts, labels 0/1 and how many rows of the table each stands for."""
    if len(set(y.tolist())) < 2:
        share = float((weights * y).sum() / weights.sum()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        p = fresh()
        p["wo"][:] = 0
        return Model(p, 1.0, float(np.log(share / (1 - share))))
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        return Model(learn(texts, y), 1.0, 0.0)
    p = learn([t for t, a in zip(texts, aside, strict=True) if not a], y[~aside])
    kept = [t for t, a in zip(texts, aside, strict=True) if a]
    got = np.concatenate([logits(p, np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in kept])
    return Model(p, *calibrate(got, y[aside], weights[aside]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows: docs has doc_id and text, labels doc_id and toxic."""
    # the draw has about 2 * per_class short rows, so it goes to the texts and not they to it
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").alias("y")).dropDuplicates(["doc_id"])
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    got = docs.select("doc_id", "text").join(F.broadcast(drawn(known, "doc_id", "y", per_class)), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")).collect()
    got.sort(key=lambda r: (r.doc_id, r.text))
    y = np.array([r.y for r in got], float)
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weights = np.array([total.get(int(v), 1) / n[int(v)] for v in y])
    return fit([r.text.encode() for r in got], y, weights)


def score_column(model: Model, column: pa.Array) -> np.ndarray:
    out = [logits(model.params, data, offs) for _, _, data, offs in text_blocks(column, 1 << 19)]
    x = np.concatenate([np.zeros(0), *out])
    return 1 / (1 + np.exp(-np.clip(model.slope * x + model.shift, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of being toxic of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_column(shared.value, b.column(1)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(score_column(shared.value, b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
