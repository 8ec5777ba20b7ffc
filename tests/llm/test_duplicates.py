"""Near-duplicates and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import SCHEMA, Sets, awkward, near_components, repeats, sentence

from gapfield.llm import embeddings, hnsw, minhash, substrings, suffixarray
from gapfield.llm.components import components


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    s = Sets()
    for a, b in edges:
        s.join(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: s.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def family(r: random.Random, n: int) -> list[str]:
    """Texts that drift: each is an edit of one before, so groups hold pairs below the threshold too."""
    out = [sentence(r, r.randint(20, 90)) for _ in range(6)]
    while len(out) < n:
        w = r.choice(out).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = sentence(r, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates(spark, seed, monkeypatch):
    if seed:  # groups are cut into many blocks
        monkeypatch.setattr(minhash, "BLOCK_NODES", 16)
    r = random.Random(seed)
    rows = awkward() + [(100 + i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(family(r, 260))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = minhash.near_duplicates(docs).collect()
    want = near_components([(d, t) for d, t, *_ in rows])
    expected = Counter((d, *want[i], want[i][1] is None or d == want[i][1]) for i, (d, *_) in enumerate(rows))
    assert Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got) == expected
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted({x.doc_id for x in kept.collect()} - {None}) == sorted({d for i, (d, *_) in enumerate(rows) if d is not None and want[i][1] == d})
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_corrected_estimate_is_close():
    r = np.random.default_rng(3)
    for size, share in ((40, 0.8), (2000, 0.75), (100_000, 0.9)):
        common = r.integers(0, 2**63, int(size * share), dtype=np.uint64) * np.uint64(2)
        a = np.unique(np.concatenate([common, r.integers(0, 2**63, size - len(common), dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
        b = np.unique(np.concatenate([common, r.integers(0, 2**63, size - len(common), dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
        a, b = np.sort(minhash.mix(a)), np.sort(minhash.mix(b))
        same = np.array([(minhash.registers(a) == minhash.registers(b)).sum()])
        chance = minhash.collisions(np.array([len(a)]), np.array([len(b)]))
        j = len(common) / (2 * size - len(common))
        assert abs((same / 128 - chance) / (1 - chance) - j) < 0.17
        assert minhash.promising(same, np.array([size]), np.array([size]), int(100 * j))[0]


def test_suffix_array_and_common_prefixes():
    r = random.Random(2)
    for _ in range(400):
        t = bytes(r.choice(b"ab" if r.random() < 0.5 else b"abcd\xff") for _ in range(r.randint(0, 60)))
        x = np.frombuffer(t, np.uint8)
        order = suffixarray.suffix_array(x, 100)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = suffixarray.common_prefixes(x, order, 100)
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :], t[order[k] :]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] == n


def passages(seed: int) -> list[tuple]:
    r = random.Random(seed)
    shared = [sentence(r, 70) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [sentence(r, r.randint(0, 60)) for _ in range(3)]
        if r.random() < 0.7:
            p = r.choice(shared)
            parts.insert(r.randrange(4), p[r.randint(0, 80) :])
        texts.append("é".join(parts))
    texts += [texts[0], texts[1] + texts[1], "ab" * 600, "z" * 399, "z" * 400, "y" * 401]
    return awkward() + [(200 + i, t, None, None, len(t), None, None, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [False, True])
def test_substrings(spark, hot, monkeypatch):
    if hot:  # every anchor is counted by window digests
        monkeypatch.setattr(substrings, "HOT_BYTES", 500)
    rows = passages(7)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    flags = repeats([(t or "").encode() for _, t, *_ in rows], 400)
    want, texts = Counter(), Counter()
    for (d, t, *_), m in zip(rows, flags):
        raw = (t or "").encode()
        kept = bytes(b for b, x in zip(raw, m) if not x)
        want[d, len(raw), sum(m), sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1])), hashlib.sha256(kept).hexdigest()] += 1
        texts[d, kept.decode("utf-8", "ignore")] += 1
    got = substrings.removals(docs).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    assert Counter((x.doc_id, x.text) for x in out.collect()) == texts
    assert substrings.removals(docs.where("false")).count() == 0


def vectors() -> list[tuple]:
    r = np.random.default_rng(5)
    rows = []
    for c in range(30):
        centre = r.normal(size=16)
        rows += [centre + r.normal(size=16) * 0.12 for _ in range(r.integers(1, 25))]
    rows += [rows[0], rows[1], rows[1] * 2]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 0.0], [1.0, 0.0]]
    out = [(i, v, "x", "y") for i, v in enumerate(rows + bad)]
    return out + [(3, rows[3], None, None), (None, rows[5], None, None)]


def test_vectors(spark):
    rows = vectors()
    s, ok = Sets(), []
    for i, (_, v, *_) in enumerate(rows):
        good = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, float) if good else None)
        s.find(i)
    links = [0] * len(rows)
    for i, a in enumerate(ok):
        for j, b in enumerate(ok):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                links[i] += 1
                s.join(i, j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[s.find(i)] = min(least.get(s.find(i), d), d)
    want = Counter()
    for i, (d, *_) in enumerate(rows):
        c = least.get(s.find(i))
        want[d, links[i], c, c is None or d == c] += 1
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, node string, shard string")
    got = embeddings.near_duplicates(docs).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in got) == want
    assert embeddings.near_duplicates(docs.where("false")).count() == 0


def test_graph_recall():
    r = np.random.default_rng(0)
    centres = r.normal(size=(60, 24))
    v = embeddings._unit(np.concatenate([centres[r.integers(0, 60, 3000)] + r.normal(size=(3000, 24)) * 0.2, r.normal(size=(2000, 24))]))
    g = hnsw.build(v)
    width = embeddings.audited(g, v[::50], 0.9)
    exact = v[:400] @ v.T
    found = np.concatenate([np.stack([a, p], 1) for a, p in hnsw.within(g, v[:400], 0.9, width)])
    assert (exact[found[:, 0], found[:, 1]] >= 0.9 - 1e-6).all() and len(np.unique(found, axis=0)) == len(found)
    assert len(found) >= 0.99 * (exact >= 0.9).sum()
    ids, _ = hnsw.nearest(g, v[:200], 128)
    top = np.argsort(-exact[:200], 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), top.tolist())]) >= 0.9


def test_audit_of_a_shard_without_drawn_links():
    """A shard that no shared vector links with is audited by its own members, not passed unseen."""
    r = np.random.default_rng(1)
    v = embeddings._unit(r.normal(size=(12_000, 64)))
    g = hnsw.build(v)
    own = np.arange(0, len(v), 60)
    sample = embeddings._unit(r.normal(size=(1, 64)))
    assert not (sample @ v.T >= 0.8).any()
    width = embeddings.audited(g, sample, 0.9, own)
    assert width > embeddings.FIRST_BEAM
    exact = v[own] @ v.T
    ids, _ = hnsw.nearest(g, v[own], width)
    top = np.argsort(-exact, 1)[:, :11]
    assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(ids.tolist(), top.tolist())]) >= 0.9
