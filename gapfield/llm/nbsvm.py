"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by log-count ratios.

Features are indicators of hashed n-grams: byte n-grams of one to three, words and word pairs (A-Z
lower-cased for words; a pair of equal words is the same feature whatever the word). The ratio of a feature is the log of its smoothed share among documents of
class 1 over that of class 0. Documents are scaled to unit length after multiplication with the
ratios; the hinge loss is minimised by dual coordinate descent. A logistic curve fitted on labelled
rows kept aside turns margins into probabilities.

The model is fitted on a bounded, documented draw (``PER_CLASS`` rows per class by a hash of the
id); class weights of the calibration undo the draw, so probabilities refer to all labelled rows.

Defined results: null or empty text has no feature and gets the probability of the bias alone;
without labelled rows of both classes the score is the share of class 1 (0.5 without any rows);
equal rows are scored one by one; labels that are null or neither 0 nor 1 are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import combine, lower_table, run_hashes, text_blocks, words
from .common import drawn

BITS = 18
PER_CLASS = 2500
EPOCHS = 12
COST = 8.0


@dataclass
class Model:
    weights: np.ndarray  # hinge weight times ratio
    squares: np.ndarray  # ratio squared
    bias: float
    slope: float
    shift: float


class Features:
    """Distinct feature numbers of every text of a block."""

    def __init__(self):
        self._seen = np.zeros(1 << BITS, bool)

    def of(self, data: np.ndarray, offs: np.ndarray):
        """Yields the sorted distinct features of text after text."""
        low = lower_table()[data]
        starts, ends, row_offs = words(data, offs)
        single = run_hashes(low, starts, ends, 5)
        double = combine(single[:-1], single[1:])
        cut = np.uint64(64 - BITS)
        again = single[:-1] == single[1:]
        single, double = (single >> cut).astype(np.int32), (double >> cut).astype(np.int32)
        double[again] = 0  # one pair feature for all words that stand twice in a row
        own = data.astype(np.uint32)
        grams = [own]
        for k in (1, 2):
            if len(own) > k:
                grams.append((grams[-1][:-1] << np.uint32(8)) | own[k:])
        hashed = []
        for k, g in enumerate(grams):
            h = (g + np.uint32(k << 24)) * np.uint32(2654435769)
            h ^= h >> np.uint32(15)
            hashed.append(((h * np.uint32(2246822519)) >> np.uint32(32 - BITS)).astype(np.int32))
        for i in range(len(offs) - 1):
            a, b, u, v = int(offs[i]), int(offs[i + 1]), int(row_offs[i]), int(row_offs[i + 1])
            parts = [h[a : max(a, b - k)] for k, h in enumerate(hashed)] + [single[u:v], double[u : max(u, v - 1)]]
            if b - a < 20_000:
                yield np.unique(np.concatenate(parts))
                continue
            for p in parts:
                self._seen[p] = True
            found = np.flatnonzero(self._seen).astype(np.int32)
            self._seen[found] = False
            yield found


def margins(model: Model, rows) -> np.ndarray:
    out = []
    for f in rows:
        size = np.sqrt(model.squares[f].sum())
        out.append(model.weights[f].sum() / size + model.bias if size else model.bias)
    return np.array(out)


def probability(model: Model, margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))


def descend(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is one more feature of value 1."""
    w, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[f] / max(np.sqrt((ratio[f] ** 2).sum()), 1e-12) for f in rows]
    alpha = np.zeros(len(rows))
    square = np.array([(v**2).sum() + 1 for v in values])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through weighted labels, by Newton steps with a small ridge."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 1e-2 * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        b = b - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Model from feature rows, labels 0/1 and how many rows of the table each stands for."""
    size = 1 << BITS
    share = float((weights * labels).sum() / weights.sum()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))

    def learn(part):
        own = [rows[i] for i in part]
        lab = labels[part]
        seen = [np.bincount(np.concatenate([r for r, x in zip(own, lab, strict=True) if x == c] or [np.zeros(0, np.int32)]), minlength=size) + 1.0 for c in (1, 0)]
        ratio = np.log(seen[0] / seen[0].sum()) - np.log(seen[1] / seen[1].sum())
        ratio[(seen[0] == 1) & (seen[1] == 1)] = 0  # never seen
        balance = np.where(lab == 1, 0.5 / max((lab == 1).mean(), 1e-9), 0.5 / max((lab == 0).mean(), 1e-9))
        w, bias = descend(own, ratio, np.where(lab == 1, 1.0, -1.0), COST * balance)
        return Model(w * ratio, ratio**2, bias, 1.0, 0.0)

    aside = np.arange(len(rows)) % 5 == 0
    if len(set(labels[~aside].tolist())) == 2 and len(set(labels[aside].tolist())) == 2:
        first = learn(np.flatnonzero(~aside))
        slope, shift = calibrate(margins(first, [rows[i] for i in np.flatnonzero(aside)]), labels[aside], weights[aside])
    else:
        slope, shift = 2.0, 0.0
    model = learn(np.arange(len(rows)))
    model.slope, model.shift = slope, shift
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows: docs has doc_id and text, labels doc_id and the label column."""
    # the draw has about 2 * per_class short rows, so it goes to the texts and not they to it
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).dropDuplicates(["doc_id"])
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn(known, "doc_id", "y", per_class)), "doc_id").select("doc_id", "text", "y")

    def run(batches):
        features = Features()
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(1)):
                rows = [f.tobytes() for f in features.of(data, offs)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(rows, pa.binary())], ["doc_id", "y", "features"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, y int, features binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.features)))
    y = np.array([r.y for r in got], float)
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weights = np.array([total.get(int(v), 1) / n[int(v)] for v in y])
    return fit([np.frombuffer(r.features, np.int32) for r in got], y, weights)


def score_column(model: Model, column: pa.Array) -> np.ndarray:
    features = Features()
    out = [probability(model, margins(model, features.of(data, offs))) for _, _, data, offs in text_blocks(column)]
    return np.concatenate([np.zeros(0), *out])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of class 1 of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_column(shared.value, b.column(1)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
