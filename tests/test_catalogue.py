"""Every registered query of the core library against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from kbspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(v):
    return "~" if v is None else repr(round(v, 8)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    r = con.execute(catalogue.ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(plain(x[c]) for c in cols) for x in rows) == sorted(tuple(map(plain, x)) for x in r.fetchall())


def test_workflow_resolve_with_ids_beyond_a_million(spark, tmp_path):
    """A view of a late event has a larger number than a click of an early one; each user's places differ in number."""
    rows = [(1, 2_000_005, "view"), (1, 7, "click"), (2, 1_500_000, "view"), (2, 9, "error"), (3, 3, "click"), (3, 900_000, "view"), (4, 5_000_000, "error")]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.id, r.place) for r in catalogue.QUERIES["workflow_resolve"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(c.execute(catalogue.ORACLE_SQL["workflow_resolve"]).fetchall()) == {(1, 7), (2, 1_500_000), (3, 900_000), (4, 5_000_000)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
