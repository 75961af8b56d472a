"""Every registered query against its DuckDB oracle at the smallest scale."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from waymark.plans.catalog import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(rows, order):
    cells = [
        tuple(round(r[i], 9) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order)
        for r in rows
    ]
    return sorted(cells, key=lambda row: [(c is not None, str(c)) for c in row])


def kinds(rows, order):
    """Python types of each column's cells; widths of numbers do not show in them."""
    return [{type(r[i]) for r in rows} - {type(None)} for i in order]


def test_entry_registers_the_catalog():
    assert entry.queries().items() >= QUERIES.items()
    assert entry.oracle_sql().items() >= ORACLES.items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = df.collect()
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    rows = cursor.fetchall()
    want = canonical(rows, [columns.index(c) for c in names])
    assert kinds(got, [df.columns.index(c) for c in names]) == kinds(rows, [columns.index(c) for c in names])
    assert canonical(got, [df.columns.index(c) for c in names]) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
