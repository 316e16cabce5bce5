import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import ledgerloom
from ledgerloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")


def test_without_the_optional_part(monkeypatch):
    """What can't be imported is left out; the other queries stay."""
    monkeypatch.setitem(sys.modules, "ledgerloom.llm.queries", None)
    monkeypatch.delattr(ledgerloom.llm, "queries", raising=False) if hasattr(ledgerloom, "llm") else None
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLE_SQL)


def rows_of(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: [(v is None, str(v)) for v in r])


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["append_chain", "append_actor_chains", "verify_violations", "redact_rows", "bundle_headers", "query_page", "verify_many_chains", "verify_duplicates", "escaped_pointers", "json_ingest"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert rows_of(df.select(*columns).collect()) == rows_of(expected)
