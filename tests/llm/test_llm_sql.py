import glob
import os
from collections import Counter

import duckdb
import pytest

from dieflow.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    want = Counter(tuple(sorted(zip(columns, r), key=lambda x: x[0])) for r in cur.fetchall())
    assert Counter(tuple(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, SF).collect()) == want
