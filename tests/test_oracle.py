"""Every registered query against its DuckDB text on the given tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registered
from tests.conftest import DATA

QUERIES = registered.queries()
TEXTS = registered.oracle_sql()
# Reports that are empty at the smallest scale are compared one scale up.
SCALE = os.environ.get("BOLETIM_TEST_SF", "sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/{SCALE}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sortable(row):
    return tuple((cell is None, str(type(cell)), cell if cell is not None else 0) for cell in row)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=_sortable)


# Text operators, where installed, have tests of their own.
REPORTS = sorted({*registered._QUERIES, "r2_exact_grades"})


def test_every_query_has_a_text():
    assert set(REPORTS) <= set(TEXTS) <= set(QUERIES)


@pytest.mark.parametrize("name", REPORTS)
def test_matches_duckdb(spark, duck, name):
    found = QUERIES[name](spark, f"{DATA}/{SCALE}")
    wanted = duck.execute(TEXTS[name])
    columns = [column[0] for column in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    expected = _rows(columns, wanted.fetchall())
    assert expected, "an empty result would prove nothing"
    assert _rows(found.columns, [tuple(row) for row in found.collect()]) == expected
