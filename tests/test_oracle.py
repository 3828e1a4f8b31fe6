"""Every named query against its SQL twin: same columns, types and rows."""

import glob
import os

import duckdb
import pytest
from helpers import TESTDATA

import __spark_entry__
from parkpulse.plans.catalog import catalog as queries
from parkpulse.plans.oracle import oracle_sql

SF_DIR = f"{TESTDATA}/sf{os.environ.get('TEST_SF', '0.001')}"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(__spark_entry__.queries())
    assert set(oracle_sql()) <= set(__spark_entry__.oracle_sql())


def _types(table):
    names = {"string_view": "string", "large_string": "string"}
    return {f.name: names.get(str(f.type), str(f.type)) for f in table.schema}


def _rows(table):
    columns = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in columns]
    return sorted(zip(*data), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(queries()))
def test_matches_sql(spark, duck, name):
    got = queries()[name](spark, SF_DIR).toArrow()
    expected = duck.sql(oracle_sql()[name]).to_arrow_table()
    assert _types(got) == _types(expected)
    assert _rows(got) == _rows(expected)
