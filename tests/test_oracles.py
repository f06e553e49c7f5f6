"""Every registered query against its DuckDB oracle (order-insensitive)."""

import pytest

import __spark_entry__ as E
from harness import compare, duck
from statgate.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = {name: make() for name, make in catalog.ORACLES.items()}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, catalog.QUERIES[name], ORACLES[name], SF, con)
    assert r["match"], r


def test_every_query_has_an_oracle():
    missing = set(catalog.QUERIES) - set(ORACLES)
    assert not missing, missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["dataset_id", "validation_name", "status", "message"]
    assert df.count() == 16
