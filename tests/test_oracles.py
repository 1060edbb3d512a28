"""Every registered query runs; those with SQL text must equal DuckDB row by row."""

import pytest
from oracle_check import compare

from trialframe.plans.catalog import ORACLES, QUERIES

# all ten methods at once: covered by tests/oracle_check.py
SLOW = {"run_matrix"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck_con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck_con.execute(ORACLES[name]).fetchdf()
    assert compare(got, want) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
