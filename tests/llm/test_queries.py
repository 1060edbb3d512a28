"""Every registered query runs; those with SQL text must equal DuckDB row by row, the others a brute-force version elsewhere in this folder."""

import pytest
from oracle_check import compare

from trialframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck_con, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir).toPandas(), duck_con.execute(ORACLES[name]).fetchdf()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
