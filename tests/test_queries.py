import decimal
import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from dieflow.plans import queries as Q

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    got = Counter(tuple(sorted((c, norm(v)) for c, v in r.asDict().items())) for r in Q.QUERIES[name](spark, SF).collect())
    cur = con.execute(Q.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert got == Counter(tuple(sorted((c, norm(v)) for c, v in zip(cols, r))) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["wafer_id", "truth", "pred", "rule"] and df.count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
