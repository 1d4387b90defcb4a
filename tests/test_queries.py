import os

import pytest
from tests_shared import same

from sessionloom.plans import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, name):
    sql = core.oracle_sql().get(name)
    if sql:
        same(spark, name, core.queries()[name], sql, DATA)
    else:
        assert core.queries()[name](spark, DATA).count() >= 0


def test_every_sql_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries())
