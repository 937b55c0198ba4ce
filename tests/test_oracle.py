"""Every core query against its DuckDB SQL, over whole tables."""

from __future__ import annotations

import pytest

from compare import both, database
from corpusloom.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    got, want = both(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLES[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
