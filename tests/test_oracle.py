"""Every registered unit against its DuckDB oracle (sf0.001), and the
rows-only units for a stable, non-empty result."""

import re

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck_connect
from sample_tables import SF_SMALL

# the queries of the training-data subpackage are tested in tests/llm
QUERIES = {k: v for k, v in E.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    r = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert r["ok"], r


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"league_id", "season_year", "team_id", "form_compact", "form_games"}
    rows = df.collect()
    assert rows and all(set(r.form_compact) <= set("WDL") and len(r.form_compact) <= 5 for r in rows)
