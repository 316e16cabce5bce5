import os

import duckdb
import pytest

from ledgerloom.llm.oracles import ORACLE_SQL
from ledgerloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    key = lambda rows: sorted([tuple(r) for r in rows], key=lambda r: [(v is None, str(v)) for v in r])
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert expected and key(df.select(*columns).collect()) == key(expected)
