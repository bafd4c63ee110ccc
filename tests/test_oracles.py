"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, duck_tables

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_tables(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship_figures(spark):
    got = {r["status"]: r for r in entry.entry(spark).collect()}
    assert {k: (r["n"], r["discrepancies"]) for k, r in got.items()} == {
        "matched": (246, 62), "missing_in_bank": (29, 0), "missing_in_our_file": (114, 0),
    }
    assert str(got["matched"]["our_total"]) == "52251030.85"
    assert str(got["matched"]["bank_total"]) == "61464792.40"
