import os

import pytest

from tallybrook.plans import registry

from . import twins

pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(twins.DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return twins.connect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, con, name):
    twins.compare(spark, con, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, twins.DATA).collect()


def test_entry(spark):
    assert registry.entry(spark, twins.DATA).count() > 0
