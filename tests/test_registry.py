"""Every registered query runs on sf0.001 with a stable schema; entry() works."""

import pytest

from conftest import SF001
from expstudy.plans import all_queries

NO_ORACLE = sorted(k for k, (_, sql) in all_queries().items() if not sql)


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["c_mktsegment", "l_returnflag", "n_cells", "n_rows", "actual", "expected", "ae"]


def test_contract_keys():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


@pytest.mark.parametrize("key", NO_ORACLE)
def test_rows_only_queries_run(spark, key):
    fn, _ = all_queries()[key]
    df = fn(spark, SF001)
    schema1 = df.schema
    rows = df.collect()
    assert len(rows) > 0
    assert fn(spark, SF001).schema == schema1
