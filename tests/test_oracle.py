"""Every registered query with an oracle matches DuckDB at sf0.01."""

import pytest

from conftest import SF01
from expstudy.plans import all_queries
from oracle import compare, duck

KEYS = sorted(k for k, (_, sql) in all_queries().items() if sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    fn, sql = all_queries()[key]
    ok, msg = compare(fn(spark, SF01), con, sql)
    assert ok, f"{key}: {msg}"
