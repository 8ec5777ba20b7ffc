"""Stream queries whose parts arrive in several files."""

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["stream_progress", "stream_phases", "stream_align"])
def test_a_part_of_several_files_is_one_trigger(spark, scratch, name):
    """The watermark of one file must not make the rows of the next late, and files don't count as batches."""
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(f"{scratch}/events.parquet")
    got = entry.queries()[name](spark, scratch)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{DATA}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    cols = sorted(want.columns)
    key = lambda d: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False))
    assert key(got.select(*cols).toPandas()) == key(want)
