"""Language identification by interpolated Kneser-Ney character models.

Per language one character model of order ``order`` over letter runs, lower-cased and padded with
a begin and an end mark. Counts below the highest order are continuation counts; every order has
its own absolute discount; the lowest order is interpolated with a uniform floor. The probabilities
of all languages lie in one sorted array of gram hashes per order (one column per language) and one
sorted array of context hashes for the interpolation weights, so a binary search answers all
languages at once. A letter run is scored once per block of texts and its result reused.

The prediction is the language with the lowest cross-entropy per character (letters and one end per
run); ties go to the first language in sorted order. ``score`` is the normalised likelihood of that
language for ``EVIDENCE`` characters at most. ``rejected`` marks texts whose cross-entropy is above
a threshold calibrated on training texts kept aside: the ``QUANTILE`` of the entropies of those with
``EVIDENCE`` characters or more (of all, if none is so long), plus ``MARGIN`` bits, plus ``SHORT`` bits
over the root of the text's characters. A few wrong labels or junk texts don't move a quantile.

Defined results: null, empty or letterless text is ``und`` with score 0 and rejected; a table
without any labelled text gives ``und`` everywhere; rows with equal ids are scored one by one;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import code_points, combine, mix, ranges, run_hashes, runs, text_blocks
from .charclass import LETTER, char_classes, lower_points
from .common import drawn

UNKNOWN = "und"
ORDER = 4
# At most about so many labelled texts of a language are read for its model, drawn by a hash of the
# id; whole texts are used.
PER_LANGUAGE = 1500
EVIDENCE = 40
QUANTILE, MARGIN, SHORT = 0.75, 0.45, 8.0
# Texts are classified in blocks of so many bytes; one holds some twenty arrays of eight bytes a character.
CLASSIFY_BYTES = 1 << 19
_BEGIN, _END = 0x110000, 0x110001


@dataclass
class KneserNey:
    """Models of all languages: per order sorted gram hashes, sorted context hashes, their values."""

    languages: list[str]
    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float
    limits: np.ndarray


def letter_runs(data: np.ndarray, offs: np.ndarray):
    """Lower-cased code points of a block and its letter runs: points, starts, ends, row offsets."""
    points, offs = code_points(data, offs)
    starts, ends, row_offs = runs(char_classes(points) == LETTER, offs)
    return lower_points(points), starts, ends, row_offs


def _padded(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int):
    """Runs with order-1 begin marks before and one end mark after, one after the other."""
    lens = ends - starts
    out_at = np.concatenate([[0], np.cumsum(lens + order)])
    text = np.full(int(out_at[-1]), _BEGIN, np.int64)
    text[ranges(out_at[:-1] + order - 1, lens)] = points[ranges(starts, lens)]
    text[out_at[1:] - 1] = _END
    targets = ranges(out_at[:-1] + order - 1, lens + 1)
    return text, targets


def _gram_hashes(text: np.ndarray, targets: np.ndarray, order: int):
    """For k = 1..order the hash of the k characters that end at each target, and of those before it."""
    chars = mix(text.astype(np.uint64) + np.uint64(7))
    context = np.full(len(targets), 1, np.uint64)
    grams, contexts = [], []
    for k in range(1, order + 1):
        if k > 1:
            context = combine(context, chars[targets - (k - 1)])
        contexts.append(context)
        grams.append(combine(context, chars[targets]))
    return grams, contexts


def _model(points, starts, ends, counts, order: int):
    """Interpolated probabilities and weights of one language from its counted runs."""
    text, targets = _padded(points, starts, ends, order)
    weight = np.repeat(counts, ends - starts + 1)
    gram_h, ctx_h = _gram_hashes(text, targets, order)
    grams, probs, contexts, weights = [], [], [], []
    lower_of = {}
    for k in range(order, 0, -1):
        g, first, inv = np.unique(gram_h[k - 1], return_index=True, return_inverse=True)
        if k == order:
            c = np.bincount(inv, weight)
        else:
            # in how many different characters a gram is preceded
            pairs = np.unique(combine(gram_h[k], gram_h[k - 1]), return_index=True)[1]
            c = np.bincount(inv[pairs], minlength=len(g)).astype(float)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        h, h_inv = np.unique(ctx_h[k - 1][first], return_inverse=True)
        total = np.bincount(h_inv, c)
        grams.append(g)
        contexts.append(h)
        weights.append(discount * np.bincount(h_inv) / total)
        probs.append(np.maximum(c - discount, 0) / total[h_inv])
        lower_of[k] = (first, h_inv)
    grams, probs, contexts, weights = grams[::-1], probs[::-1], contexts[::-1], weights[::-1]
    alphabet = len(np.unique(text)) + 1
    below = np.full(len(targets), 1.0 / alphabet)
    for k in range(1, order + 1):
        first, h_inv = lower_of[k]
        probs[k - 1] = probs[k - 1] + weights[k - 1][h_inv] * below[first]
        below = probs[k - 1][np.searchsorted(grams[k - 1], gram_h[k - 1])]
    return grams, probs, contexts, weights, alphabet


def _join(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = np.full((len(keys), len(parts)), np.nan, np.float32)
    for i, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), i] = v
    return keys, values


def _counted(texts: list[bytes]):
    """The distinct letter runs of texts and how often each occurs: points, starts, ends, counts."""
    own, sizes, hashes, counts = [], [], [], []
    for _, _, data, offs in text_blocks(pa.array(texts, pa.binary()), 1 << 19):
        points, starts, ends, _ = letter_runs(data, offs)
        h, first, n = np.unique(run_hashes(points, starts, ends), return_index=True, return_counts=True)
        lens = (ends - starts)[first]
        own.append(points[ranges(starts[first], lens)])
        sizes.append(lens), hashes.append(h), counts.append(n)
    if not own:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    points, lens = np.concatenate(own), np.concatenate(sizes)
    _, first, inv = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    starts = np.cumsum(lens) - lens
    return points, starts[first], (starts + lens)[first], np.bincount(inv, np.concatenate(counts))


def fit(texts: dict[str, list[bytes]], order: int = ORDER) -> KneserNey:
    """Models from texts per language. Every fifth text calibrates the rejection only."""
    models = {}
    for lang in sorted(texts):
        kept = [t for i, t in enumerate(texts[lang]) if i % 5 or len(texts[lang]) < 5]
        part = _counted(kept) if kept else (None, [], [], [])
        if len(part[1]):
            models[lang] = _model(*part, order)
    langs = list(models)
    if not langs:
        return KneserNey([], [], [], [], [], 1.0, np.zeros(0))
    grams, probs, contexts, weights = [], [], [], []
    for k in range(order):
        g, p = _join([(models[x][0][k], models[x][1][k]) for x in langs])
        c, w = _join([(models[x][2][k], models[x][3][k]) for x in langs])
        grams.append(g), probs.append(p), contexts.append(c), weights.append(w)
    model = KneserNey(langs, grams, probs, contexts, weights, 1.0 / max(models[x][4] for x in langs), np.zeros(len(langs)))
    for i, lang in enumerate(langs):
        aside = [t for j, t in enumerate(texts[lang]) if j % 5 == 0 and t.strip()]
        got = [(e[0, i], size[0]) for e, size in (entropies(model, np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in aside) if size[0]]
        got = [x for x, size in got if size >= EVIDENCE] or [x for x, _ in got]
        model.limits[i] = (np.quantile(got, QUANTILE) if got else np.inf) + MARGIN
    return model


def run_bits(model: KneserNey, points, starts, ends) -> np.ndarray:
    """Bits of every run in every language, its end mark included."""
    order = len(model.grams)
    text, targets = _padded(points, starts, ends, order)
    gram_h, ctx_h = _gram_hashes(text, targets, order)
    p = np.full((len(targets), len(model.languages)), model.floor, np.float32)
    for k in range(order):
        keys, at = model.contexts[k], np.searchsorted(model.contexts[k], ctx_h[k])
        at = np.minimum(at, len(keys) - 1)
        w = np.where((keys[at] == ctx_h[k])[:, None], model.weights[k][at], np.nan)
        keys, at = model.grams[k], np.searchsorted(model.grams[k], gram_h[k])
        at = np.minimum(at, len(keys) - 1)
        q = np.where((keys[at] == gram_h[k])[:, None], model.probs[k][at], np.nan)
        backed = np.where(np.isnan(w), p, w * p)
        p = np.where(np.isnan(q), backed, q)
    bits = -np.log2(p)
    return np.add.reduceat(bits, np.concatenate([[0], np.cumsum(ends - starts + 1)[:-1]]), axis=0)


def entropies(model: KneserNey, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of every text in every language (NaN without letters), and characters."""
    points, starts, ends, row_offs = letter_runs(data, offs)
    n = len(offs) - 1
    if not len(starts):
        return np.full((n, len(model.languages)), np.nan), np.zeros(n)
    _, first, inv = np.unique(run_hashes(points, starts, ends), return_index=True, return_inverse=True)
    bits = run_bits(model, points, starts[first], ends[first]).astype(float)[inv]
    total = np.zeros((len(bits) + 1, bits.shape[1]))
    np.cumsum(bits, axis=0, out=total[1:])
    chars = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    size = (chars[row_offs[1:]] - chars[row_offs[:-1]]).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (total[row_offs[1:]] - total[row_offs[:-1]]) / size[:, None], size


def classify(model: KneserNey, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of every text of a column."""
    langs, scores, rejected = [], [], []
    for lo, hi, data, offs in text_blocks(column, CLASSIFY_BYTES):
        if not model.languages:
            langs += [UNKNOWN] * (hi - lo)
            scores.append(np.zeros(hi - lo))
            rejected.append(np.ones(hi - lo, bool))
            continue
        e, size = entropies(model, data, offs)
        none = size == 0
        e[none] = 0
        best = e.argmin(1)
        low = e[np.arange(len(e)), best]
        share = np.exp2(-(e - low[:, None]) * np.minimum(size, EVIDENCE)[:, None])
        langs += [UNKNOWN if x else model.languages[b] for b, x in zip(best, none, strict=True)]
        scores.append(np.where(none, 0.0, 1 / share.sum(1)))
        rejected.append(none | (low > model.limits[best] + SHORT / np.sqrt(np.maximum(size, 1))))
    return langs, np.concatenate([np.zeros(0), *scores]), np.concatenate([np.zeros(0, bool), *rejected])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER) -> KneserNey:
    """Fit on (doc_id, text, lang) rows; rows without text or language are left out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = drawn(rows, "doc_id", "lang", per_language).orderBy("doc_id", "text").collect()
    texts: dict[str, list[bytes]] = {}
    for r in sample:
        texts.setdefault(r.lang, []).append(r.text.encode())
    return fit(texts, order)


def predict(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, scores, rejected = classify(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: KneserNey) -> DataFrame:
    """The rows, all columns as they are, whose text is in a known language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(~classify(shared.value, b.column(at))[2]))

    return docs.mapInArrow(run, docs.schema)
