"""The pN queries on the smallest tables: against SQL where there is SQL, else whole and distinct."""

import glob
import os

import duckdb
import pytest

from quillgraph.llm import queries as Q
from tools_oracle import norm

SF = os.environ.get("QUILL_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name in Q.ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        assert norm(got) == norm(con.execute(Q.ORACLE[name]).df())
    else:
        rows = norm(got)
        assert len(set(rows)) == len(rows) and rows
