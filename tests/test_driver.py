import math
import re
import sys

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NO_ORACLE = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle_but_the_listed():
    own = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own - set(entry.oracle_sql()) == NO_ORACLE
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_the_text_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert entry.queries() == entry.QUERIES and entry.oracle_sql() == entry.ORACLES


def test_entry(spark):
    d = entry.entry(spark)
    assert d.count() == 1500 and d.columns[:3] == ["qid", "tri_id", "hits"]


def key(row):
    return tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n in entry.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(want.columns) == cols
    a = sorted(key(r) for r in got.select(*cols).toPandas().itertuples(index=False))
    b = sorted(key(r) for r in want[cols].itertuples(index=False))
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b) if x != y]
    # values that sit on a rounding step may differ in the last digit
    for x, y in off:
        for p, q in zip(x, y):
            assert p == q or math.isclose(float(p), float(q), rel_tol=1e-6, abs_tol=2e-5), (name, x, y)
