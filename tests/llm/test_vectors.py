"""Hard negatives and whitening against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest

from gapfield.llm import boxtree, feast, negatives, whitening

SCHEMA = "vec_id bigint, embedding array<double>, label int, score double, dim string, uid string, shard int, rank int, n int, component string"
EXTRA = (0.5, "d", "u", 1, 2, 3, "c")


def rows_of(vectors, labels, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return [(i, None if v is None else [None if x is None else float(x) for x in v], label, *EXTRA) for i, v, label in zip(ids, vectors, labels, strict=True)]


def brute_negatives(rows, anchor):
    """Rows of (anchor, positive, rank, negative, scores), by sorting all rows per question."""
    usable = []
    for vec_id, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if any(abs(x) > math.sqrt(2.0**63 / len(q)) - 1 for x in q):
            continue
        usable.append((vec_id, label, q))
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for a, (vec_id, label, q) in enumerate(usable):
        if vec_id is None or not anchor(vec_id):
            continue
        scored = [(sum(x * y for x, y in zip(q, w, strict=True)), i, same == label) for b, (i, same, w) in enumerate(usable) if b != a and len(w) == len(q)]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            fit = sorted((s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:10]
            out += [(vec_id, pid, k + 1, nid, p, s) for k, (s, nid, _) in enumerate(fit)]
    return sorted(out, key=str)


def mined(df, **more):
    names = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return sorted((tuple(r[n] for n in names) for r in negatives.mine(df, "vec_id % 5 = 0", **more).collect()), key=str)


@pytest.mark.parametrize("shards", [1, 7])
def test_hard_negatives_equal_brute_force(spark, shards):
    r = np.random.default_rng(shards)
    centres = r.normal(size=(6, 12))
    vectors = list(centres[r.integers(0, 6, 260)] + 0.4 * r.normal(size=(260, 12)))
    vectors += [vectors[5]] * 12 + [-vectors[0], np.zeros(12), vectors[3][:7], vectors[4][:7], vectors[9][:7], [], [], []]
    vectors += [None, [None] * 12, [math.nan] * 12, [math.inf] + [0] * 11, [1e30] * 12, [2e5] * 12]
    labels = [int(x) for x in r.integers(0, 3, len(vectors))]
    labels[7] = labels[30] = None
    rows = rows_of(vectors, labels)
    rows += [rows[10], rows[10], (None, *rows[11][1:]), (20, *rows[21][1:]), (2**62, *rows[22][1:])]
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    assert len(want) > 500
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3), shards=shards) == want


def test_hard_negatives_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    r = np.random.default_rng(3)
    rows = rows_of(list(r.normal(size=(150, 5)).round(1)), [int(x) for x in r.integers(-1, 2, 150)])
    assert mined(spark.createDataFrame(rows, SCHEMA), shards=3) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == []
    assert mined(spark.createDataFrame(rows_of([None, [1.0], [1.0]], [1, None, 1]), SCHEMA)) == []
    assert mined(spark.createDataFrame(rows_of([[1.0], [1.0]], [1, 1]), SCHEMA)) == []


def test_box_tree_prunes_and_is_exact():
    r = np.random.default_rng(2)
    centres = r.integers(-4000, 4000, (40, 3))
    points = (np.repeat(centres, 200, 0) + r.integers(-20, 20, (8000, 3))).astype(np.int16)
    tree = boxtree.build(points, np.repeat(np.arange(2), 4000), np.arange(8000), np.arange(8000))
    queries = r.integers(-300, 300, (9, 3))
    low, high = np.full(9, -(1 << 40)), np.full(9, 1 << 40)
    for same in (True, False):
        top = boxtree.search(tree, queries, np.arange(9) % 2, np.full(9, -1), low, high, 4, same)
        for i, q in enumerate(queries):
            scores = points.astype(int) @ q
            own = (np.repeat(np.arange(2), 4000) == i % 2) == same
            want = sorted((-int(s), int(k)) for k, s in enumerate(scores) if own[k])[:4]
            assert [(-int(a), int(b)) for a, b in zip(top.score[i], top.id[i], strict=True)] == want
    # boxes of the leaves are tight: on average a small share of the extent of all rows
    lo, hi, *_ = tree.boxes[0]
    assert (hi.astype(int) - lo).mean() < 0.2 * (points.max(0).astype(int) - points.min(0)).mean()
    assert sorted(boxtree.tiled(points)) == list(range(8000))


@pytest.mark.parametrize("kind", ["bulk", "cluster", "rank", "equal", "one", "zero"])
def test_contour_integration(kind):
    r = np.random.default_rng(7)
    d = 1 if kind == "one" else 48
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    spectrum = {"bulk": r.uniform(1, 2, d), "cluster": np.r_[1e4, 1 + 1e-4 * r.random(d - 1)], "rank": np.r_[r.random(5) + 1, np.zeros(max(d - 5, 0))][:d], "equal": np.r_[np.full(20, 3.0), np.full(28, 1.0)], "one": [2.5], "zero": np.zeros(d)}[kind]
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    values, axes = feast.largest(v, 30)
    want = np.sort(spectrum)[::-1][:30]
    scale = max(want[0], 1.0)
    assert np.allclose(values, want, atol=1e-11 * scale, rtol=0)
    assert np.allclose(axes.T @ axes, np.eye(len(want)), atol=1e-12)
    assert np.abs(v @ axes - axes * values).max() < 1e-11 * scale
    shifts = np.array([0.5, 1.00005, 2.0, 50.0])
    assert feast.Inertia(v).above(shifts).tolist() == [int((np.linalg.eigvalsh(v) > s).sum()) for s in shifts]


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = list(r.normal(size=(300, 7)) @ r.normal(size=(7, 7)))
    vectors += [vectors[0]] * 200 + [[1.5, 2.5], [0.5, -1.0], [3.0, 0.25], [], None, [None] * 7, [math.nan] * 7, [math.inf] * 7, [1e300] * 7]
    rows = rows_of(vectors, [None] * len(vectors))
    rows += [rows[3], (None, *rows[4][1:])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = whitening.whiten(df, 5).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for d in (7, 2):
        own = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v, *_ in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) and abs(x) < 1e200 for x in v)]
        x = np.array([v for _, v in own], object)
        n, s = len(own), x.sum(0)
        cov = np.array([[float(Fraction(int(n * (x[:, i] * x[:, j]).sum() - s[i] * s[j]), n * n)) for j in range(d)] for i in range(d)])
        e, u = np.linalg.eigh(cov)
        e, u = e[::-1], u[:, ::-1]
        k = min(5, d)
        mine = got[got.n == n]
        assert len(mine) == n * k and sorted(mine.component.unique()) == list(range(1, k + 1))
        deviation = {i: int(((n * np.array(v, object) - s) ** 2).sum()) for i, v in own}
        for c in range(k):
            w = {}
            for i, v in own:
                w.setdefault(i, float((np.array(v, object) * n - s).astype(float) @ u[:, c] / n / math.sqrt(e[c])))
            part = mine[mine.component == c + 1]
            ids = [None if math.isnan(i) else int(i) for i in part.vec_id]
            sign = np.sign(sum(a * w[i] for a, i in zip(part.whitened, ids, strict=True)))
            assert np.allclose(part.whitened * sign, [w[i] for i in ids], atol=1e-9)
            assert np.allclose(part.explained, e[c] / np.trace(cov), rtol=1e-9)
            assert [int(x) for x in part.deviation] == [deviation[i] for i in ids]
        assert (mine.identity_error < 1e-9).all()


def test_whitening_without_spread(spark):
    same = whitening.whiten(spark.createDataFrame(rows_of([[1.0, 2.0]] * 3, [0] * 3), SCHEMA)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error is None for r in same)
    flat = whitening.whiten(spark.createDataFrame(rows_of([[1.0, 2.0], [1.0, 3.0], [1.0, 5.0]], [0] * 3), SCHEMA)).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True} and all(r.identity_error < 1e-12 for r in flat)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows_of([None, []], [0, 0]), SCHEMA)).count() == 0


def test_exact_sums_of_large_entries():
    z = np.array([[1 << 40, 3], [-(1 << 41), 5]])
    assert whitening._gram(z).tolist() == [[(1 << 80) + (1 << 82), 3 * (1 << 40) - 5 * (1 << 41)], [3 * (1 << 40) - 5 * (1 << 41), 34]]
    fit = whitening.Fit(2, [10, 0], np.array([5, 0]), [18, 6, 2], 2)
    w, deviation = fit.whitened(np.array([[8, 1], [2, -1]]))
    assert deviation == [40, 40] and np.isnan(w[:, 1]).all() and np.allclose(np.abs(w[:, 0]), 1)


def test_the_audit_scan_holds_a_few_rows_at_a_time():
    """Its memory must not grow with the sample times the shard (here 2048 x 6000 numbers, 49 MB)."""
    import tracemalloc

    from gapfield.llm import embeddings, hnsw

    rng = np.random.default_rng(5)
    vectors = embeddings._unit(rng.normal(size=(6000, 8)))
    sample = embeddings._unit(rng.normal(size=(2048, 8)))
    points, links = np.arange(6000), np.full((6000, 4), -1, np.int64)
    graph = hnsw.Graph(vectors, [(points, links)])
    tracemalloc.start()
    embeddings.audited(graph, sample, 2.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
