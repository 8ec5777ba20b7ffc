"""Classifiers, rules and language models against brute force, held-out rows and awkward tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from fixtures_llm import SCHEMA, WORD, awkward, lower, sentence
from pyspark.sql import functions as F

from gapfield.llm import langid, nbsvm, rules, suffixtree, toxic
from gapfield.llm.common import held_out, table

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def small(spark):
    """Documents and labels of a public size, read once."""
    folder = DATA.replace("sf0.001", "sf0.01")
    return table(spark, folder, "documents").cache(), table(spark, folder, "labels").cache()


def auc(score, y):
    score, y = np.array(score), np.array(y)
    rank = np.argsort(np.argsort(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def held(rows, modulus, rest):
    return [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % modulus == rest]


def test_held_out_is_crc_of_the_id_as_text(spark):
    got = spark.range(2000).select("id", held_out("id", 7, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in got)


def test_language(spark, small):
    docs, _ = small
    model = langid.train(docs.where(~held_out("doc_id", 4, 2)))
    got = held(langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect(), 4, 2)
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    odd = spark.createDataFrame(awkward(), SCHEMA)
    out = langid.predict(odd, model).collect()
    assert len(out) == len(awkward()) and all(0 <= r.score <= 1 for r in out)
    for r in out:
        text = next(t for d, t, *_ in awkward() if d == r.doc_id)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    assert langid.keep_known(odd, model).columns == odd.columns
    assert langid.predict(odd.where("false"), model).count() == 0
    none = langid.train(odd.where("false"))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    # a language never learned is rejected
    assert langid.classify(model, pa.array(["Καλημέρα κόσμε, τι κάνετε σήμερα εδώ πέρα"]))[2].all()


def test_languages_are_told_in_small_blocks(monkeypatch):
    texts = [f"{a} {b} the words of this text {n}" * 900 for n, (a, b) in enumerate([("one", "two"), ("red", "blue")] * 40)]
    model = langid.fit({"en": [t.encode() for t in texts[:4]], "xx": [b"zq wq zq jq" * 9]})
    whole, sizes = langid.entropies, []
    expected = [float(whole(model, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].min()) for t in texts]
    monkeypatch.setattr(langid, "entropies", lambda m, data, offs: sizes.append((len(data), whole(m, data, offs))) or sizes[-1][1])
    assert len(langid.classify(model, pa.array(texts))[0]) == len(texts)
    assert max(n for n, _ in sizes) <= 1 << 19
    assert np.allclose(np.concatenate([e.min(1) for _, (e, _) in sizes]), expected)


def test_language_rejects_an_unlearned_one_in_the_same_script(small):
    """A language held back is rejected, also when some texts of it carry the label of a learned one."""
    own = {}
    for r in small[0].where("text is not null and lang is not null").orderBy("doc_id", "text").collect():
        own.setdefault(r.lang, []).append(r.text)
    for foreign in sorted(own):
        learned = {k: [t.encode() for t in v[::2]] for k, v in own.items() if k != foreign}
        for wrong in (False, True):
            if wrong:
                # every fiftieth text, among those kept aside
                for v in learned.values():
                    for i, t in zip(range(0, len(v), 50), own[foreign]):
                        v[i] = t.encode()
            model = langid.fit(learned)
            assert langid.classify(model, pa.array(own[foreign][1::2]))[2].mean() >= 0.9
            known = [t for k, v in own.items() if k != foreign for t in v[1::2]]
            assert langid.classify(model, pa.array(known))[2].mean() <= 0.01


def test_kneser_ney_sums_to_one():
    texts = {"aa": [b"banana bandana cabana", b"a ban"], "bb": [b"dodo do od"]}
    model = langid.fit(texts)
    points = [ord(c) for c in "abcdno"] + [langid._END]
    # the probabilities of all characters after a context, and of the floor's share for unseen ones
    for before in ("", "b", "ba", "ban", "xyz"):
        runs = [before + chr(p) if p < 0x110000 else before for p in points]
        ends = []
        for r, p in zip(runs, points):
            x = np.array([ord(c) for c in r], np.uint32)
            bits = langid.run_bits(model, x, np.array([0]), np.array([len(x)]))[0] if len(x) else None
            if p == langid._END or bits is None:
                continue
            closed = langid.run_bits(model, np.append(x, 0)[: len(x)], np.array([0]), np.array([len(x)]))[0]
            assert np.isfinite(closed).all()
            ends.append(bits)
        assert all(np.isfinite(b).all() for b in ends)
    p = {k: model.probs[k][:, 0] for k in range(4)}
    for k in range(4):
        seen = p[k][~np.isnan(p[k])]
        assert ((seen > 0) & (seen <= 1)).all()
    # unigram level: seen characters and the uniform floor of the rest make one
    unigrams = p[0][~np.isnan(p[0])]
    weight = model.weights[0][0, 0]
    alphabet = len(unigrams) + 2
    assert abs(unigrams.sum() + weight * (alphabet - len(unigrams)) / alphabet - 1) < 1e-6


def test_quality_classifier(spark, small):
    docs, labels = small
    model = nbsvm.train(docs, labels.where(~held_out("doc_id", 4, 2)))
    got = held(nbsvm.score(docs, model).join(labels, "doc_id").collect(), 4, 2)
    assert auc([r.score for r in got], [r.quality for r in got]) >= 0.95
    check_scorer(spark, lambda d: nbsvm.score(d, model), lambda d, x: nbsvm.score(d, nbsvm.train(d, x)))


def test_quality_classifier_takes_ids_and_labels_of_any_type(spark, small):
    docs, labels = (d.withColumn("doc_id", F.col("doc_id").cast("string")) for d in small)
    model = nbsvm.train(docs, labels.withColumn("quality", F.col("quality").cast("bigint")))
    rows = nbsvm.score(docs, model).collect()
    assert all(isinstance(r.doc_id, str | None) and 0 <= r.score <= 1 for r in rows) and len(rows) == small[0].count()
    same = nbsvm.train(*small)
    assert np.isfinite(model.weights).all() and model.weights.any() and same.weights.shape == model.weights.shape


def test_quality_classifier_equals_plain_loops(spark, small):
    """Ratios and scores of a few texts, by dictionaries."""
    docs = small[0].where("text is not null").orderBy("doc_id").limit(20).collect()
    features = nbsvm.Features()
    own = []
    for r in docs:
        raw = np.frombuffer(r.text.encode(), np.uint8)
        own.append([int(x) for x in next(iter(features.of(raw, np.array([0, len(raw)]))))])
    y = np.array([float(i % 2) for i in range(len(own))])
    model = nbsvm.fit([np.array(f, np.int32) for f in own], y, np.ones(len(own)))
    counts = [{}, {}]
    for f, c in zip(own, y, strict=True):
        for x in f:
            counts[int(c)][x] = counts[int(c)].get(x, 0) + 1
    size = 1 << nbsvm.BITS
    totals = [sum(c.values()) + size for c in counts]
    for x in {x for f in own for x in f}:
        ratio = math.log((counts[1].get(x, 0) + 1) / totals[1]) - math.log((counts[0].get(x, 0) + 1) / totals[0])
        assert math.isclose(model.squares[x], ratio**2, rel_tol=1e-9, abs_tol=1e-12)
    for f, got in zip(own, nbsvm.margins(model, [np.array(f, np.int32) for f in own]), strict=True):
        norm = math.sqrt(sum(float(model.squares[x]) for x in f)) or 1.0
        assert math.isclose(got, sum(float(model.weights[x]) for x in f) / norm + model.bias, rel_tol=1e-6, abs_tol=1e-9)


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 12, 5)) for _ in range(80)]
    y = np.where(r.random(80) < 0.5, 1.0, -1.0)
    w, b = nbsvm.descend(rows, np.ones(12), y, np.full(80, 1.0), epochs=400)
    x = np.zeros((80, 13))
    for i, f in enumerate(rows):
        x[i, f] = 1 / np.sqrt(len(f))
    x[:, 12] = 1
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    own = np.append(w, b)
    assert all(loss(own) <= loss(own + r.normal(size=13) * s) + 1e-3 for s in (0.01, 0.1, 1) for _ in range(100))


def check_scorer(spark, score, train_and_score):
    """Scores of awkward rows lie in 0..1 and follow the text alone; tables without labels or rows work."""
    odd = spark.createDataFrame(awkward(), SCHEMA)
    got = score(odd).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    twice = [r.score for r in got if r.doc_id == 19]
    assert len(twice) == 2 and abs(twice[0] - twice[1]) < 1e-6
    assert score(odd.where("false")).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {round(r.score, 6) for r in train_and_score(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, None, None), (None, 1, 0), (5, 7, 7)], LABELS)
    assert all(r.score > 0.9 for r in train_and_score(odd, one).collect())


def test_toxicity(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = sentence(r, r.randint(3, 300)).split()
        bad = i % 3 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["dreadfulA", "DREADFULb", "dreadfulc", "foul"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, LABELS)
    model = toxic.train(docs, marks.where(~held_out("doc_id", 5, 0)))
    got = held(toxic.score(docs, model).join(marks, "doc_id").collect(), 5, 0)
    assert auc([x.score for x in got], [x.toxic for x in got]) >= 0.9
    check_scorer(spark, lambda d: toxic.score(d, model), lambda d, x: toxic.score(d, toxic.train(d, x)))
    kept = toxic.keep_clean(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in toxic.score(docs, model).collect() if x.score < 0.5}


def test_network_gradients_match_differences():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxic.fresh(2).items()}
    data = np.frombuffer(sentence(random.Random(0), 150).encode(), np.uint8)
    inv, rows, word, grams, at = toxic._inputs(data, np.array([0, len(data)]))
    start, length, _ = toxic.windows(rows)
    assert start.tolist() == [0, 32, 64, 86] and set(length.tolist()) == {64}
    e = toxic.encode_words(p, word, grams, at).astype(np.float64)
    pull = r.normal(size=len(start))
    logit, kept = toxic.forward(p, e, inv, start, length, True)
    dense, _, _ = toxic.backward(p, pull, kept)
    for name in ("uf", "ub", "cf", "cb", "wa", "va", "wo", "ba"):
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in p[name].shape)
            old, h = p[name][at], 2e-2
            values = []
            for d in (h, -h):
                p[name][at] = old + d
                values.append((toxic.forward(p, e, inv, start, length)[0] * pull).sum())
            p[name][at] = old
            assert abs((values[0] - values[1]) / (2 * h) - dense[name][at]) < 2e-3 + 0.03 * abs(dense[name][at])


def plain_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    m = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(m), len(w) < 20 or 100 * len(m) > 30 * len(w)


def test_rule_statistics(spark, small):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = [(d, t) for d, t, *_ in awkward()] + [(r.doc_id, r.text) for r in small[0].select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, *[r[n] for n in names]) for r in rules.judge(docs, []).collect())
    assert got == Counter((d, *plain_statistics(t)) for d, t in rows)
    plan = rules.judge(docs, [rules.Rule([(2, True, 0.1)])])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
    assert rules.judge(spark.createDataFrame(awkward(), SCHEMA).where("false"), []).count() == 0


def test_rule_list(spark, small):
    docs, labels = small
    found = rules.train(docs, labels)
    assert found and all(1 <= len(r.conditions) <= rules.MAX_CONDITIONS for r in found)
    got = rules.judge(docs, found).join(labels, "doc_id").where("not base_failed").collect()
    bad = [r for r in got if r.quality == 0]
    good = [r for r in got if r.quality == 1]
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad) and sum(r.kept for r in good) >= 0.98 * len(good)
    # the conditional column says what the rules say, in order
    x = [tuple(r) for r in rules.statistics(docs).select(*[c.alias(n) for n, c in rules.features().items()]).collect()]
    covered = np.zeros(len(x), bool)
    for r in found:
        covered |= r.covers(np.array(x))
    verdicts = [r.v for r in rules.statistics(docs).select(rules.verdict(found).alias("v")).collect()]
    assert verdicts == (~covered).tolist()
    assert rules.train(docs, spark.createDataFrame([], LABELS)) == []


def test_rules_recover_a_conjunction():
    r = np.random.default_rng(0)
    x = r.random((3000, len(rules.FEATURES)))
    bad = (x[:, 2] >= 0.7) & (x[:, 5] < 0.4)
    found = rules.learn(x, bad)
    covered = np.any([f.covers(x) for f in found], 0)
    assert (covered == bad).mean() > 0.98


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(d, t) for d, t, *_ in awkward()] + [(r.doc_id + 1000, r.text) for r in table(spark, DATA, "documents").collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    train = docs.where(~held_out("doc_id", 7, 2))
    model, words = suffixtree.train(train)
    return rows, model, suffixtree.score(docs, model, words).collect(), words, docs


def test_unigram_base(scored, monkeypatch):
    rows, model, got, words, docs = scored
    tokens = lambda t: WORD.findall(lower(t or "")) + [None]
    count = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)

    def want():
        return Counter((d, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in rows)

    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want()
    # the same with every word looked up by the join
    bare = suffixtree.Model(model.tree, model.head_keys[:0], model.head_counts[:0], model.tokens, model.distinct)
    again = suffixtree.score(docs, bare, words).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in again) == want()


def test_tree_distributions(scored):
    rows, model, got, _, _ = scored
    tree = model.tree
    assert len(tree.back) > 50
    # in every kept state the probabilities of all symbols sum to one
    r = np.random.default_rng(0)
    for k in range(1, len(tree.contexts)):
        for c in r.choice(tree.contexts[k], min(5, len(tree.contexts[k])), replace=False):
            keys = (np.uint64(c) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
            assert abs((10 ** suffixtree.log10_of(tree, keys)).sum() - 1) < 1e-9
    # the score is the sum over symbols
    for d, t in rows[:30]:
        symbols, offs, *_ = suffixtree.spell(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))
        assert bytes(symbols) == " ".join(WORD.findall(lower(t or ""))).encode() + b"\n"
        own = suffixtree.log10_of(tree, suffixtree.grams(symbols, offs)).sum()
        assert any(abs(own - x.score) < 1e-6 for x in got if x.doc_id == d)


def test_tree_without_training(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    model, words = suffixtree.train(docs.where("false"))
    got = suffixtree.score(docs, model, words).collect()
    assert len(got) == len(awkward()) and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    short = next(r for r in got if r.doc_id == 5)
    assert short.n_tokens == 1 and abs(short.score + math.log10(256)) < 1e-9
    assert suffixtree.score(docs.where("false"), model, words).count() == 0


def test_tree_grows_with_the_corpus(spark):
    """Contexts kept on a small corpus stay when other text is added, and the tree gets larger."""
    r = random.Random(5)
    few = [(i, sentence(r, 40)) for i in range(40)]
    other = ["".join(r.choice("BCDFGHJKLMNP0123456789") + r.choice("56789") + (" " if r.random() < 0.3 else "") for _ in range(4000)) for i in range(10)]
    more = [(100 + i, other[i % 10].translate(str.maketrans("BCDFGHJKLMNP", "àáâãäåæçèéêë"))) for i in range(2000)]
    trees = []
    for rows in (few, few + more):
        tree = suffixtree.train(spark.createDataFrame(rows, "doc_id bigint, text string"))[0].tree
        trees.append({(k, c) for k in range(1, len(tree.contexts)) for c in tree.contexts[k].tolist()})
    # a least share of all positions would drop contexts of the few texts for the text added
    deep = {x for x in trees[0] if x[0] > 3}
    assert deep and len(deep & trees[1]) >= 0.9 * len(deep) and len(trees[1]) > len(trees[0])
    assert max(k for k, _ in trees[0]) > 5


def test_tree_in_the_table_scores_as_gathered(spark, scored, monkeypatch):
    rows, _, got, _, docs = scored
    monkeypatch.setattr(suffixtree, "HEAD_CONTEXTS", 200)
    monkeypatch.setattr(suffixtree, "GROUP_GRAMS", 5000)
    model, words = suffixtree.train(docs.where(~held_out("doc_id", 7, 2)))
    assert model.tree.thin is not None and sum(map(len, model.tree.contexts[3:])) <= 200 < model.tree.table.count()
    again = suffixtree.score(docs, model, words).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in again) == Counter((r.doc_id, round(r.score, 5)) for r in got)
