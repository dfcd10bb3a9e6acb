import os

import pytest

from tallybrook.llm import queries

from .. import twins

pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(twins.DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    twins.compare(spark, twins.connect(), queries.queries()[name], queries.oracle_sql()[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
