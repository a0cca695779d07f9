"""Every query that has SQL gives the rows that DuckDB gives; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from provenio import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EMPTY_AT_THIS_SIZE = set()


def plain(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int | float):
        return repr(round(float(value), 6))
    return str(value)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows
    if name in registry.ORACLE_SQL:
        with duckdb.connect() as db:
            for file in os.listdir(SF):
                db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
            made = db.execute(registry.ORACLE_SQL[name])
            names = [d[0] for d in made.description]
            assert sorted(names) == columns
            want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in made.fetchall())
        assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
