"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest
from check_oracles import compare, duck

import __spark_entry__ as contract
from chainevents.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, connection, name):
    function, sql = REGISTRY[name]
    assert compare(connection, spark, SF, function, sql) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and {r.outcome for r in rows} == {"Results"}
    keys = [(r.block_number, r.log_index) for r in rows]
    assert keys == sorted(keys) and all(300 <= k[0] <= 499 for k in keys)
    assert set(contract.oracle_sql()) <= set(contract.queries())
