"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from veilspark.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, sf_dir, name):
    sql = registry.sql().get(name)
    if sql:
        assert compare(spark, con, registry.queries()[name], sql, sf_dir) == ""
    else:
        assert registry.queries()[name](spark, sf_dir).count() >= 0


def test_entry_registers_every_core_query():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
