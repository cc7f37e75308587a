"""Every registered query runs, gives rows, and equals its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows_of
from plotmark.session import drop_scratch

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Thresholds of these queries leave nothing of the smallest tables.
LARGER = "/root/testdata/sf0.01"
NEEDS_LARGER = {
    "median_fee", "qualified_metros", "area_rate_coverage", "support_filter", "qualify_groups", "fee_by_county",
    "fee_by_division",
}


@pytest.fixture(scope="module")
def con(sf):
    def connect(folder):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con

    return {folder: connect(folder) for folder in (sf, LARGER)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    folder = LARGER if name in NEEDS_LARGER else sf
    got = QUERIES[name](spark, folder).toArrow()
    drop_scratch(spark)
    assert got.num_rows
    if name in ORACLES:
        want = con[folder].sql(ORACLES[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows_of(got) == rows_of(want)
