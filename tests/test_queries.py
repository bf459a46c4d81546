"""Every query of the catalog against its SQL, run by DuckDB on the same tables; those without SQL run and return rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    yield con
    con.close()


def rows_of(columns, rows):
    """The rows with their columns by name, in an order that the last digits of doubles don't change."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = [[row[k] for k in order] for row in rows]
    return sorted(plain, key=lambda row: [f"{x:.5g}" if isinstance(x, float) else str(x) for x in row])


def same(a, b):
    if a is None or b is None or isinstance(a, str | bool) or not isinstance(a, float | int | Decimal):
        return a == b or str(a) == str(b)
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-9) or (math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, found.fetchall())
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_imports_and_names_agree():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())
