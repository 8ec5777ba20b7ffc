"""The pipeline's stages against brute force on the smallest tables, and the registered queries."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from conftest import DATA
from fixtures_llm import SCHEMA, awkward, near_components, repeats

import __spark_entry__ as entry
import corpus_pipeline
from gapfield.llm import langid, minhash, toxic
from gapfield.llm.common import table


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, each written and read again as the driver does."""
    import tempfile

    docs, out = table(spark, DATA, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/{k}"
        stage(spark, docs, DATA).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((name, docs, got))
        docs = got
    return out


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _, _ in stages] == ["language", "toxicity", "near_duplicates", "repeated_passages", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_language_stage(stages):
    _, before, after = stages[0]
    model = langid.train(before)
    own = before.orderBy("doc_id").collect()
    rejected = langid.classify(model, pa.array([r.text for r in own], pa.string()))[2]
    assert rows(after, "doc_id", "text") == Counter((r.doc_id, r.text) for r, no in zip(own, rejected) if not no)
    assert after.count() >= 0.99 * before.count()


def test_toxicity_stage(spark, stages):
    _, before, after = stages[1]
    model = toxic.train(before, table(spark, DATA, "labels"))
    own = before.orderBy("doc_id").collect()
    # a text's score does not depend on the texts around it
    scores = [toxic.score_column(model, pa.array([r.text]))[0] for r in own]
    sure = [(r, s) for r, s in zip(own, scores) if abs(s - 0.5) > 1e-3]
    kept = rows(after, "doc_id", "text")
    for r, s in sure:
        assert ((r.doc_id, r.text) in kept) == (s < 0.5)
    labels = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect()}
    clean = [r for r in own if labels.get(r.doc_id) == 0]
    assert sum((r.doc_id, r.text) in kept for r in clean) >= 0.95 * len(clean)


def test_near_duplicate_stage(stages):
    _, before, after = stages[2]
    own = [(r.doc_id, r.text) for r in before.collect()]
    want = near_components(own)
    assert rows(after, "doc_id", "text") == Counter((d, t) for i, (d, t) in enumerate(own) if want[i][1] in (None, d))


def test_near_duplicate_stage_keeps_one_row_of_a_group(spark):
    """A repeated id with two texts, repeated rows, and copies without ids."""
    a, b, c, e = (" ".join(f"{w}{i}" for i in range(40)) for w in "abce")
    near = [c.split(), c.split(), c.split()]
    near[1][10] = near[2][10] = "x"
    near[2][25] = "y"
    link, far = " ".join(near[1]), " ".join(near[2])
    given = [(1, a), (2, a), (2, b), (3, e), (3, e), (None, link), (8, c), (9, far), (None, a), (4, ""), (4, ""), (5, None), (None, "p q r s t"), (None, "p q r s t")]
    docs = spark.createDataFrame([(d, t, "en", None, 1, *[None] * 5) for d, t in given], SCHEMA)
    after = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert rows(after, "doc_id", "text") == Counter([(1, a), (2, b), (3, e), (8, c), (4, ""), (4, ""), (5, None), (None, "p q r s t")])
    ids = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert ids[9, 36] == ids[8, 36] == 8  # linked over the row without an id


def test_passage_stage(stages):
    _, before, after = stages[3]
    own = before.collect()
    flags = repeats([r.text.encode() for r in own], 400)
    want = Counter()
    for r, m in zip(own, flags):
        text = bytes(b for b, x in zip(r.text.encode(), m) if not x).decode("utf-8", "ignore")
        want[r.doc_id, text, len(text) if any(m) else r.n_chars, r.lang, r.source] += 1
    assert rows(after, "doc_id", "text", "n_chars", "lang", "source") == want


def test_packing_stage(stages):
    _, before, after = stages[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    fill = Counter()
    for r in after.collect():
        fill[r.sequence_id] += r.length
    total = sum(fill.values())
    assert max(fill.values()) <= 2048 and len(fill) <= -(-total // 2048) + 1


def test_run_equals_the_stages(spark, stages):
    got = rows(corpus_pipeline.run(spark, DATA), "doc_id", "piece", "start", "length", "ids_crc32")
    assert got == rows(stages[-1][2], "doc_id", "piece", "start", "length", "ids_crc32")


def test_stages_survive_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), DATA).count() == 0
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == docs.columns
        out.collect()


def test_every_operator_has_its_query():
    names = {n for n in entry.queries() if re.match(r"op\d+_", n)}
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
